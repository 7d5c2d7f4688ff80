"""The driver tables seen as the engine's inputs.

Each view is SQL that both engines read; ``{name}`` stands for a table or an earlier view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cairnflow.model import CATEGORIES

_CATEGORY = "CASE p_partkey % 21 " + " ".join(f"WHEN {k} THEN '{c[0]}'" for k, c in enumerate(CATEGORIES)) + " END"
_SEVERITY = "CASE WHEN {0} THEN least(100, CAST(floor(value) AS INT)) ELSE 0 END"
_MILD = "(event_type = 'error' AND event_id % (CASE user_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 20 ELSE 40 END) = 0)"

#: Definition files made of parts: path and text, k and z standing for a part's key and size.
_FILES = [
    ("'objects/Obj', z, '/validationRules/V', k, '.validationRule-meta.xml'", "'<ValidationRule xmlns=\"urn:m\"><fullName>V', k, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN '</fullName><active>True</active><description> d ' ELSE '</fullName><active>false</active><description>' END, CASE WHEN p_size % 3 = 0 THEN '</fullName>' ELSE '</description>' END, '<errorConditionFormula>Amount &lt; ', z, '</errorConditionFormula>', CASE WHEN p_size % 4 = 0 THEN '' ELSE '<errorMessage>too small</errorMessage>' END, '</ValidationRule>'"),
    ("'objects/Obj', z, '/fields/F', k, '__c.field-meta.xml'", "'<CustomField>', CASE WHEN p_size % 2 = 0 THEN concat('<fullName>G', k, '</fullName><type>Number</type><externalId>TRUE</externalId>') ELSE '<label>L</label><formulaTreatBlanksAs>BlankAsBlank</formulaTreatBlanksAs>' END, '<formula>Amount / ', z, '</formula></CustomField>'"),
    ("'objects/Obj', z, '/fields/R', k, '__c.field-meta.xml'", "'<CustomField><formula>x</formula><summaryOperation>count</summaryOperation></CustomField>'"),
    ("'workflows/W', k, '.workflow-meta.xml'", "'<Workflow><rules><fullName>a</fullName><criteriaItems><field>F', z, '</field><operation>equals</operation><value>1</value></criteriaItems>', CASE WHEN p_size % 2 = 0 THEN '<criteriaItems><field>G</field></criteriaItems>' ELSE '' END, '<actions><name>u</name><type>FieldUpdate</type></actions></rules><rules><fullName>b</fullName><active>false</active><formula>TRUE</formula></rules><fieldUpdates><fullName>u</fullName><field>Status</field><literalValue>', z, '</literalValue></fieldUpdates>', CASE WHEN p_size % 5 = 0 THEN '<emailAlerts><fullName>m</fullName></emailAlerts>' ELSE '' END, '</Workflow>'"),
    ("'assignmentRules/A', k, '.assignmentRules-meta.xml'", "'<AssignmentRules><assignmentRule><fullName>g</fullName><ruleEntries><assignedTo>q', z, '</assignedTo></ruleEntries><ruleEntries><assignedTo>u</assignedTo><assignedToType>Queue</assignedToType><formula>X</formula></ruleEntries></assignmentRule>', CASE WHEN p_size % 2 = 0 THEN '<assignmentRule><fullName>h</fullName><active>no</active></assignmentRule>' ELSE '' END, '</AssignmentRules>'"),
    ("'flows/N', k, '.flow-meta.xml'", "'<Flow><processType>AutoLaunchedFlow</processType><status>Draft</status><start><object>Obj', z, '</object><triggerType>RecordAfterSave</triggerType></start><decisions><name>d</name></decisions><decisions><name>e</name></decisions><recordUpdates><name>u</name><inputAssignments><field>A</field><value><numberValue>', z, '</numberValue></value></inputAssignments><inputAssignments><field>B</field><value><elementReference>$r</elementReference></value></inputAssignments></recordUpdates><recordCreates><name>c</name></recordCreates></Flow>'"),
    ("'flows/S', k, '.flow-meta.xml'", "'<Flow><processType>Flow</processType><screens><name>s</name></screens></Flow>'"),
    ("'flows/T', k, '.flow-meta.xml'", "'<Flow><processType>ScheduleTriggered</processType><screens><name>s</name></screens></Flow>'"),
    ("'flows/E', k, '.flow-meta.xml'", "'<Flow><processType>AutoLaunchedFlow</processType><start><triggerType>PlatformEvent</triggerType></start></Flow>'"),
    ("'flows/O', k, '.flow-meta.xml'", "'<Flow><processType>Orchestrator</processType></Flow>'"),
    ("'flows/P', k, '.flow-meta.xml'", "'<Flow><processType>Workflow</processType></Flow>'"),
    ("'flows/L', k, '.flow-meta.xml'", "'<Flow><processType>AutoLaunchedFlow</processType></Flow>'"),
    ("'sharingRules/H', k, '.sharingRules-meta.xml'", "CASE WHEN p_size % 2 = 0 THEN '<SharingRules><a>1</a></SharingRules>' ELSE 'broken <x' END"),
    ("'objects/Ev', k, '__e/Ev', k, '__e.object-meta.xml'", "CASE WHEN p_size % 2 = 0 THEN '<CustomObject><eventType>HighVolume</eventType></CustomObject>' ELSE '<CustomObject/>' END"),
    ("'lwc/b', z, '/c', k, '.js'", "'export ', k"),
    ("'classes/C', k, '.cls-meta.xml'", "'<ApexClass/>'"),
    ("'flows/X', k, '.flow-meta.xml'", "'<Flow><processType>Flow</processType></Flow>'"),
    ("'notes/', k, '.txt'", "'nothing'"),
]


def _pick(which: int) -> str:
    return f"CASE p_partkey % {len(_FILES)} " + " ".join(f"WHEN {n} THEN concat({f[which]})" for n, f in enumerate(_FILES)) + " END"


VIEWS = {
    "defs": f"SELECT p_partkey, p_size, k, z, concat('/org/', {_pick(0)}) AS path, {_pick(1)} AS content FROM (SELECT p_partkey, p_size, CAST(p_partkey AS STRING) AS k, CAST(p_size AS STRING) AS z FROM {{part}}) p",
    "obs": f"SELECT event_id AS id, concat('p', CAST(user_id % 5 AS STRING)) AS process_id, ts AS observed_at, event_type = 'error' AS diverged, {_SEVERITY.format("event_type = 'error'")} AS severity, event_type FROM {{events}}",
    "obs_mild": f"SELECT event_id AS id, concat('p', CAST(user_id % 5 AS STRING)) AS process_id, ts AS observed_at, {_MILD} AS diverged, {_SEVERITY.format(_MILD)} AS severity FROM {{events}}",
    "cdc": """SELECT event_id, lpad(CAST(event_id AS STRING), 20, '0') AS replay_id,
        CASE user_id % 3 WHEN 0 THEN 'Lead' WHEN 1 THEN 'Account' ELSE 'Opportunity' END AS sobject,
        concat('00Q', lpad(CAST(user_id AS STRING), 12, '0')) AS record_id,
        CASE WHEN event_type = 'signup' THEN 'CREATE' WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'GAP_UPDATE' ELSE 'DELETE' END ELSE 'UPDATE' END AS change_type,
        ts AS commit_ts, concat('p', CAST(user_id % 5 AS STRING)) AS process_id,
        CASE WHEN value > 300 THEN CAST(NULL AS INT) ELSE CAST(floor(value) AS INT) END AS amount, event_type AS status FROM {events}""",
    "rec_opp": """SELECT o_orderkey AS id, o_totalprice AS Amount, o_orderstatus AS Stage, o_orderpriority AS Priority, c_name AS Name, c_mktsegment AS Segment, c_acctbal AS Balance, n_name AS Country
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "rec_line": "SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS Quantity, l_extendedprice AS Price, l_discount AS Discount, l_tax AS Tax, l_returnflag AS Flag, l_linestatus AS Status FROM {lineitem}",
    "comp": f"""SELECT p_partkey AS component_id, {_CATEGORY} AS category, p_name AS name, concat('Cls', CAST(p_partkey AS STRING)) AS api_name,
        CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN 'SBQQ' WHEN p_partkey % 4 = 2 THEN p_brand ELSE 'pi' END AS namespace,
        p_size AS decisions, p_size % 9 AS dml, p_size % 6 AS subflows, p_size % 3 AS screens, p_size * 7 AS body_lines, p_size % 5 AS n_events,
        CASE p_size % 3 WHEN 0 THEN 'ui_only' WHEN 1 THEN 'mixed' ELSE 'business_logic_heavy' END AS classification, p_size % 4 AS n_imports,
        repeat(CASE WHEN p_size % 2 = 0 THEN 'Account.Name ' ELSE 'amount ' END, p_size) AS formula, p_size % 7 AS callouts FROM {{part}}""",
    "raw_meta": """SELECT s.source, concat('cat', CAST(p_size % 5 AS STRING)) AS category, concat('c', CAST(p_partkey AS STRING)) AS api_name, CASE WHEN p_partkey % 3 = 0 THEN CAST(NULL AS STRING) ELSE p_brand END AS namespace, p_partkey,
        f.field, CASE f.field WHEN 'type' THEN p_type WHEN 'size' THEN CAST(p_size + CASE WHEN s.source = 'salto' AND p_partkey % 7 = 0 THEN 1 ELSE 0 END AS STRING) ELSE concat(s.source, '!') END AS value
        FROM {part} CROSS JOIN (SELECT 'salto' AS source, 0 AS k UNION ALL SELECT 'sf_cli', 1 UNION ALL SELECT 'tooling_api', 2) s
        CROSS JOIN (SELECT 'type' AS field UNION ALL SELECT 'size' UNION ALL SELECT 'note') f
        WHERE (p_partkey + s.k) % 4 <> 0 AND NOT (f.field = 'note' AND s.source = 'salto')""",
    "edges": "SELECT DISTINCT concat('p', CAST(l_partkey AS STRING)) AS src, concat('s', CAST(l_suppkey AS STRING)) AS dst FROM {lineitem}",
    "chain": "SELECT l_partkey AS src, l_partkey + l_linenumber AS dst FROM {lineitem}",
    "cfg": """SELECT n_name AS process_id, CAST(CASE n_nationkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 25 WHEN 4 THEN 50 ELSE 100 END AS INT) AS stage_percent,
        concat('seed', CAST(n_nationkey AS STRING)) AS hash_seed, CAST('2024-01-01 00:00:00' AS {ntz}) AS entered_stage_at, n_nationkey FROM {nation}""",
    "traffic": "SELECT n_name AS process_id, concat('r', CAST(o_orderkey AS STRING)) AS record_id FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 4 OR o_orderkey % 2 = 0",
    "lines": """SELECT concat('f', CAST(user_id % 7 AS STRING)) AS file, event_id * 10 + k AS line_no, user_id, event_id, event_type,
        CASE k WHEN 0 THEN CASE WHEN event_id % 11 = 0 THEN 'no time here' ELSE concat('10:00:00.1 (', CAST(event_id AS STRING), ')|EXECUTION_STARTED') END
        WHEN 1 THEN CASE event_id % 13 WHEN 5 THEN '10:00:00.25 (2)|HEAP_ALLOCATE|[1]|Bytes:8' WHEN 6 THEN '10:00:00.25 (2)|VALIDATION_PASS' ELSE concat('10:00:00.25 (2)|USER_INFO|[EXTERNAL]|0', lpad(CAST(user_id AS STRING), 14, '0'), '|u') END
        WHEN 2 THEN concat('10:00:01.5 (3)|DML_BEGIN|[', CAST(event_id AS STRING), ']|Op:', CASE WHEN event_type = 'purchase' THEN 'Insert' ELSE 'Update' END, '|Type:Lead|Rows:', CAST(user_id % 3 + 1 AS STRING))
        WHEN 3 THEN CASE WHEN event_type = 'error' THEN concat('10:00:02.0 (4)|VALIDATION_FAIL|x Name:Rule_', CAST(user_id % 4 AS STRING)) ELSE concat('10:00:02.0 (4)|FLOW_START_INTERVIEW_BEGIN|id|Flow', CAST(user_id % 3 AS STRING)) END
        ELSE '10:00:03.0 (5)|EXECUTION_FINISHED' END AS value
        FROM {events} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ks WHERE event_type IN ('purchase', 'error')""",
    "saves": """SELECT CAST(floor(event_id / 20) AS BIGINT) AS txn, event_id AS seq, CASE user_id % 5 WHEN 0 THEN 'User' WHEN 1 THEN 'PermissionSet' ELSE concat('Obj', CAST(user_id % 3 AS STRING)) END AS sobject,
        CASE WHEN event_id % 9 = 0 THEN '' ELSE concat('r', CAST(user_id % 6 AS STRING)) END AS record_id FROM {events}""",
    "alloc": "SELECT CAST(s_suppkey AS STRING) AS process_id, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS weight, CAST(s_suppkey % 13 AS BIGINT) AS consumed FROM {supplier}",
    "requests": "SELECT CAST(l_suppkey AS STRING) AS process_id, l_orderkey * 10 + l_linenumber AS seq, CAST(l_linenumber AS BIGINT) AS cost FROM {lineitem}",
    "saga": """SELECT l_orderkey AS saga_id, l_linenumber AS seq, CASE WHEN l_quantity < 4 THEN 'requires_human' WHEN l_returnflag = 'R' THEN 'log_only' ELSE 'compensate' END AS kind,
        l_linestatus = 'O' AS has_fn, l_partkey % 5 = 0 AS raises FROM {lineitem}""",
    "findings": """SELECT o_orderkey AS finding_id, CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'deliberate_simplification' WHEN 1 THEN 'discovered_undocumented' ELSE 'platform_imposed_deviation' END AS category,
        CASE WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'open' END AS customer_disposition, CASE WHEN o_totalprice > 200000 THEN 'major' WHEN o_totalprice > 100000 THEN 'minor' ELSE 'info' END AS severity FROM {orders}""",
    "script": "SELECT page_id, html AS source FROM {pages}",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    used = set(re.findall(r"\{(\w+)\}", VIEWS[name])) - {"ntz"}
    return spark.sql(VIEWS[name].replace("{ntz}", "TIMESTAMP_NTZ"), **{u: view(spark, sf_dir, u) for u in used})


def as_cte(*names: str) -> str:
    """The views as a WITH clause of the other engine."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n].replace('{ntz}', 'TIMESTAMP'))})" for n in names)
