"""Fixed values of the domain, and the schemas of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# They must equal the domain's for right results.
#: category, translation difficulty, migration risk, default tier, order-of-execution steps
CATEGORIES = [
    ("record_triggered_flow", 55, 60, "tier1_rules", [4, 13]),
    ("screen_flow", 65, 30, "tier3_langgraph", []),
    ("schedule_triggered_flow", 50, 50, "tier2_temporal", []),
    ("platform_event_triggered_flow", 55, 55, "tier2_temporal", [13]),
    ("autolaunched_flow", 50, 45, "tier1_rules", [13]),
    ("flow_orchestration", 75, 70, "tier2_temporal", [13]),
    ("apex_trigger", 70, 75, "tier1_rules", [5, 9]),
    ("apex_class", 65, 60, "tier2_temporal", []),
    ("validation_rule", 20, 50, "tier1_rules", [6]),
    ("formula_field", 35, 70, "tier1_rules", []),
    ("workflow_rule", 30, 40, "tier1_rules", [12]),
    ("process_builder", 60, 55, "tier1_rules", [13]),
    ("approval_process", 80, 90, "tier2_temporal", [20]),
    ("assignment_rule", 25, 40, "tier1_rules", [10]),
    ("auto_response_rule", 25, 25, "tier2_temporal", [11, 21]),
    ("escalation_rule", 60, 65, "tier2_temporal", [14]),
    ("sharing_rule", 70, 80, "tier1_rules", [17]),
    ("rollup_summary", 40, 55, "tier1_rules", [16, 18]),
    ("platform_event", 30, 50, "tier2_temporal", [20]),
    ("change_data_capture", 40, 50, "tier2_temporal", [20]),
    ("lwc_bundle", 50, 35, "tier3_langgraph", []),
]
STEPS = [
    "load_initial_records", "load_old_records", "system_validation", "pre_trigger_flow", "before_triggers", "custom_validation", "duplicate_rules",
    "save_record", "after_triggers", "assignment_rules", "auto_response_rules", "workflow_rules", "processes_and_flows", "escalation_rules",
    "entitlement_rules", "rollup_summary", "sharing_rules", "parent_rollup", "commit_dml", "post_commit_logic", "email_send",
]
#: Categories near the border of the first two tiers.
DUAL_TARGET = ["autolaunched_flow", "record_triggered_flow", "workflow_rule", "auto_response_rule"]
#: Stage percents with the hours to dwell in each.
STAGES = [(0, 0), (1, 48), (5, 24), (25, 12), (50, 6), (100, 0)]
ADVANCE, ROLLBACK, IMMEDIATE, REGRESSION = 98, 95, 90, 95
WINDOW_DAYS, MIN_EVENTS, ELIGIBLE = 30, 100, 98
LAG_HOURS, CASCADE_LIMIT, CHUNK = 60, 16, 200
SETUP_OBJECTS = ["user", "group", "groupmember", "permissionset", "permissionsetassignment", "queuesobject", "userrole", "profile"]
PACKAGES = {"sbqq": "cpq", "apxt": "conga", "dsfs": "docusign", "et4ae5": "marketing_cloud_connect", "pi": "pardot"}
PRECEDENCE = {"salto": 0, "sf_cli": 1, "tooling_api": 2, "fixture": 50}
PARITY_CATEGORIES = ["deliberate_simplification", "discovered_undocumented", "platform_imposed_deviation", "customer_requested_improvement"]
#: Patterns in the engine's dialect; \z is the very end.
IDENTIFIER = r"\A[A-Za-z][A-Za-z0-9_]*(?:__c|__e|__mdt|__b|__x)?\z"
RECORD_ID = r"\A(?:[A-Za-z0-9]{15}|[A-Za-z0-9]{18})\z"
FIELD_PATH = r"\A[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z][A-Za-z0-9_]*)*\z"
LOG_LINE = r"^(\d{2}:\d{2}:\d{2}\.\d+)\s+\((\d+)\)\|(.*)$"
LOG_DML = r"DML_BEGIN\|\[(\d+)\]\|Op:(\w+)\|Type:(\w+)\|Rows:(\d+)"
LOG_USER = r"USER_INFO\|\[EXTERNAL\]\|(0\w{14,17})"
LOG_FAILURE = r"VALIDATION_FAIL\|.*?Name:([\w.]+)"
SCRIPT_IMPORT = r"@[a-z]+/apex/([A-Za-z0-9_]+\.[A-Za-z0-9_]+)"
SCRIPT_SIGNALS = {
    "wire_calls": r"@wire\s*\(",
    "imperative_calls": r"\b[A-Za-z_]\w*\s*\(\s*\{[^}]*\}\s*\)\s*\.then\b",
    "fetch_calls": r"\bfetch\s*\(",
    "conditionals": r"\b(if|else if|switch|case)\b",
}
TRIGGER_HEADER = r"(?i)trigger\s+(\w+)\s+on\s+(\w+)\s*\((before|after)\s+([^)]+)\)"

CDC_SCHEMA = """replay_id string, sobject string, record_id string, change_type string, commit_ts timestamp, fields map<string,string>"""


def category_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "category string, difficulty int, risk int, tier string, steps array<int>")


def step_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(STEPS, 1)), "step int, step_name string")


def stage_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STAGES, "percent int, dwell_hours int")
