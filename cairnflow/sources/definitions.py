"""Scanning a corpus of definition files and normalising what they hold.

A corpus is a folder of XML definitions, script bundles and JSON tables. Files become rows (path, content); the
category follows from the path and, for flows, from the text. Known kinds are read with a declared schema, so an
element that may repeat is an array even where it occurs once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Category and path pattern in order of priority: the first that fits decides.
PATHS = [
    ("lwc_bundle", r"/lwc/[^/]+/[^/]+$"), ("change_data_capture", r"/cdc_subscriptions\.json$"), ("validation_rule", r"\.validationRule-meta\.xml$"),
    ("formula_field", r"/fields/[^/]+\.field-meta\.xml$"), ("workflow_rule", r"\.workflow-meta\.xml$"), ("assignment_rule", r"\.assignmentRules-meta\.xml$"),
    ("auto_response_rule", r"\.autoResponseRules-meta\.xml$"), ("escalation_rule", r"\.escalationRules-meta\.xml$"), ("sharing_rule", r"\.sharingRules-meta\.xml$"),
    ("approval_process", r"\.approvalProcess-meta\.xml$"), ("flow", r"\.flow-meta\.xml$"), ("apex_trigger", r"\.trigger-meta\.xml$"), ("apex_class", r"\.cls-meta\.xml$"),
    ("platform_event", r"/objects/[^/]*__e/[^/]+\.object-meta\.xml$"),
]
SUFFIX = r"\.(validationRule|field|workflow|assignmentRules|autoResponseRules|escalationRules|sharingRules|approvalProcess|flow|trigger|cls|object)-meta\.xml$"

FLOW = """struct<apiVersion:string,processType:string,status:string,start:struct<triggerType:string,object:string,scheduledPaths:string,schedule:struct<frequency:string>>,
    decisions:array<struct<name:string>>,recordLookups:array<struct<name:string>>,recordCreates:array<struct<name:string>>,
    recordUpdates:array<struct<name:string,object:string,inputAssignments:array<struct<field:string,value:struct<stringValue:string,numberValue:string,booleanValue:string,dateValue:string,dateTimeValue:string,elementReference:string>>>>>,
    actionCalls:array<struct<name:string,actionName:string>>,subflows:array<struct<flowName:string>>,screens:array<struct<name:string>>>"""
SCHEMAS = {
    "validation_rule": "struct<fullName:string,active:string,description:string,errorConditionFormula:string,errorDisplayField:string,errorMessage:string>",
    "formula_field": "struct<fullName:string,label:string,type:string,formula:string,formulaTreatBlanksAs:string,externalId:string,summarizedField:string,summaryForeignKey:string,summaryOperation:string>",
    "workflow_rule": """struct<rules:array<struct<fullName:string,active:string,triggerType:string,formula:string,criteriaItems:array<struct<field:string,operation:string,value:string>>,actions:array<struct<name:string,type:string>>>>,
        fieldUpdates:array<struct<fullName:string,field:string,literalValue:string,formula:string,operation:string,reevaluateOnChange:string,targetObject:string>>,emailAlerts:array<struct<fullName:string,template:string>>,tasks:array<struct<fullName:string,subject:string>>,outboundMessages:array<struct<fullName:string,endpointUrl:string>>>""",
    "assignment_rule": """struct<assignmentRule:array<struct<fullName:string,active:string,ruleEntries:array<struct<assignedTo:string,assignedToType:string,formula:string,criteriaItems:array<struct<field:string,operation:string,value:string>>>>,ruleEntry:array<struct<assignedTo:string,assignedToType:string,formula:string,criteriaItems:array<struct<field:string,operation:string,value:string>>>>>>>""",
    "flow": FLOW,
}


def files(spark: SparkSession, *folders: str) -> DataFrame:
    """path and content of every file below the folders, one row each; listing and reading are distributed. Folders
    below them whose names start with an underscore are skipped unless they are named themselves."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(folders))
    return found.select("path", F.decode("content", "UTF-8").alias("content"))


def flow_variant(text: Column) -> Column:
    """The category of a flow by what its text says, the more special ones first; null for a flow of no known kind."""
    has = lambda s: F.contains(text, F.lit(s))
    kind = lambda s: has(f"<processType>{s}</processType>")
    return (
        F.when(has("<processType>RecordTriggered") | has("<triggerType>Record"), "record_triggered_flow")
        .when(has("<processType>ScheduleTriggered"), "schedule_triggered_flow")
        .when(has("<triggerType>PlatformEvent"), "platform_event_triggered_flow")
        .when(kind("Flow") & has("<screens>"), "screen_flow")
        .when(kind("Orchestrator"), "flow_orchestration")
        .when(kind("Workflow"), "process_builder")
        .when(kind("AutoLaunchedFlow") & ~has("<screens>"), "autolaunched_flow")
    )


def categorised(found: DataFrame) -> DataFrame:
    """Files with their category; files of no category are left out. A field is a formula or a roll-up, or neither;
    an object is an event only if its text says how events are published or deployed."""
    path, text = F.col("path"), F.col("content")
    has = lambda s: F.contains(text, F.lit(s))
    by_path = reduce(lambda w, p: w.when(path.rlike(p[1]), p[0]), PATHS[1:], F.when(path.rlike(PATHS[0][1]), PATHS[0][0]))
    field = F.when(has("<summaryOperation>"), "rollup_summary").when(has("<formula>"), "formula_field")
    event = F.when(has("<eventType>") | has("<deploymentStatus>"), "platform_event")
    kind = F.when(by_path == "flow", flow_variant(text)).when(by_path == "formula_field", field).when(by_path == "platform_event", event).otherwise(by_path)
    return found.withColumn("category", kind).filter("category is not null")


def api_name(path: Column) -> Column:
    """The file's name without its folder and the suffix of its kind."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), SUFFIX, "")


def object_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"/objects/([^/]+)/", 1), F.lit(""))


def first_match(candidates: DataFrame) -> DataFrame:
    """One row a path of (path, priority, ...): the smallest priority."""
    return candidates.withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy("priority"))).filter("_n = 1").drop("_n")


def bundles(found: DataFrame) -> DataFrame:
    """Script bundles: one row a folder, with its files by name."""
    own = categorised(found).filter("category = 'lwc_bundle'")
    folder = F.regexp_extract("path", r"/lwc/([^/]+)/[^/]+$", 1)
    return own.groupBy(folder.alias("api_name")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.regexp_replace("path", r"^.*/", "").alias("name"), F.col("content").alias("text"))))).alias("files"))


def parsed(found: DataFrame, category: str) -> DataFrame:
    """Definitions of a kind with their document as ``doc``; a text that is no XML has a null one."""
    kind = SCHEMAS.get(category, FLOW)
    rows = categorised(found).filter(F.col("category") == category)
    return rows.select("path", "category", api_name(F.col("path")).alias("api_name"), object_of(F.col("path")).alias("sobject"), F.from_xml("content", kind, {"mode": "PERMISSIVE"}).alias("doc"))


def _yes(x: Column, default: str = "true") -> Column:
    return F.lower(F.coalesce(x, F.lit(default))) == "true"


def _or(x: Column, default: str = "") -> Column:
    return F.coalesce(x, F.lit(default))


def _blank_as_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _each(x: Column, row) -> Column:
    """``row`` of every element that is there; no elements where there is no list."""
    return F.coalesce(F.transform(x, row), F.slice(F.array(row(F.get(x, F.lit(0)))), 2, 1))


def validation_rules(found: DataFrame) -> DataFrame:
    d = lambda c: F.col(f"doc.{c}")
    return parsed(found, "validation_rule").select(
        "path", "api_name", "sobject", _yes(d("active")).alias("active"), _or(d("description")).alias("description"), _or(d("errorConditionFormula")).alias("formula"), _or(d("errorMessage")).alias("message"),
        d("errorDisplayField").alias("display_field"),
    )


def formula_fields(found: DataFrame) -> DataFrame:
    d = lambda c: F.col(f"doc.{c}")
    return parsed(found, "formula_field").select(
        "path", "api_name", "sobject", F.coalesce(d("fullName"), "api_name").alias("field_name"), _or(d("label")).alias("label"), _or(d("type"), "Formula").alias("type"), _or(d("formula")).alias("formula"),
        _or(d("formulaTreatBlanksAs"), "BlankAsZero").alias("treat_blanks_as"), _or(d("type"), "Text").alias("return_type"), _yes(d("externalId"), "false").alias("external_id"),
    )


def _criteria(x: Column) -> Column:
    return _each(x, lambda c: F.struct(_or(c["field"]).alias("field"), _or(c["operation"]).alias("operation"), _or(c["value"]).alias("value")))


def workflow_rules(found: DataFrame) -> DataFrame:
    """One row a file, whose rules and actions are those of one object. A rule has a formula or criteria."""
    rule = lambda r: F.struct(
        _or(r["fullName"]).alias("fullName"), _yes(r["active"]).alias("active"), _or(r["triggerType"], "onCreateOnly").alias("triggerType"), _blank_as_null(r["formula"]).alias("formula"), _criteria(r["criteriaItems"]).alias("criteriaItems"),
        _each(r["actions"], lambda a: F.struct(_or(a["name"]).alias("name"), _or(a["type"]).alias("type"))).alias("actions"),
    )
    update = lambda u: F.struct(
        _or(u["fullName"]).alias("fullName"), _or(u["field"]).alias("field"), _or(u["literalValue"]).alias("literalValue"), _blank_as_null(u["formula"]).alias("formula"), _or(u["operation"]).alias("operation"),
        _yes(u["reevaluateOnChange"], "false").alias("reevaluateOnChange"), _or(u["targetObject"]).alias("targetObject"),
    )
    named = lambda c, other: _each(F.col(f"doc.{c}"), lambda x: F.struct(_or(x["fullName"]).alias("name"), _or(x[other]).alias(other)))
    return parsed(found, "workflow_rule").select(
        "path", F.col("api_name").alias("sobject"), _each(F.col("doc.rules"), rule).alias("rules"), _each(F.col("doc.fieldUpdates"), update).alias("field_updates"), named("emailAlerts", "template").alias("alerts"),
        named("tasks", "subject").alias("tasks"), named("outboundMessages", "endpointUrl").alias("messages"),
    )


def assignment_rules(found: DataFrame) -> DataFrame:
    """One row a file, with its groups and their entries in the file's order. Entries are ``ruleEntries`` elements, or
    ``ruleEntry`` ones where a group has none of the former."""
    entry = lambda e: F.struct(_or(e["assignedTo"]).alias("assignedTo"), _or(e["assignedToType"], "User").alias("assignedToType"), _blank_as_null(e["formula"]).alias("formula"), _criteria(e["criteriaItems"]).alias("criteriaItems"))
    group = lambda g: F.struct(_or(g["fullName"]).alias("name"), _yes(g["active"]).alias("active"), _each(F.coalesce(g["ruleEntries"], g["ruleEntry"]), entry).alias("entries"))
    return parsed(found, "assignment_rule").select("path", F.col("api_name").alias("sobject"), _each(F.col("doc.assignmentRule"), group).alias("groups"))


def flat_value(value: Column) -> Column:
    """A typed literal as text: the first of string, number, boolean, date, time and reference that is set."""
    return F.coalesce(*(value[k] for k in ("stringValue", "numberValue", "booleanValue", "dateValue", "dateTimeValue", "elementReference")))


def flows(found: DataFrame, category: str) -> DataFrame:
    """Flows of a category: trigger, counts of their parts, and the fields that their updates set."""
    rows = parsed(found, category)
    sets = F.flatten(_each(F.col("doc.recordUpdates"), lambda u: _each(u["inputAssignments"], lambda a: F.struct(_or(a["field"]).alias("field"), flat_value(a["value"]).alias("value")))))
    size = lambda c: F.when(F.col(f"doc.{c}").isNull(), 0).otherwise(F.size(F.col(f"doc.{c}")))
    d = lambda c, default="": _or(F.col(f"doc.{c}"), default)
    return rows.select(
        "path", "category", "api_name", d("apiVersion", "66.0").alias("api_version"), d("start.object").alias("sobject"), d("start.triggerType").alias("trigger_type"), d("processType").alias("process_type"), d("status", "Active").alias("status"),
        size("decisions").alias("decisions"), size("recordLookups").alias("lookups"), (size("recordUpdates") + size("recordCreates")).alias("dml"), size("actionCalls").alias("action_calls"), size("subflows").alias("subflows"), size("screens").alias("screens"), sets.alias("sets"),
    )


def passthrough(found: DataFrame, category: str) -> DataFrame:
    """Definitions that are kept as they are, with whether their text is XML at all."""
    rows = categorised(found).filter(F.col("category") == category)
    root = F.regexp_extract("content", r"<([A-Za-z_][\w.]*)(?:\s[^>]*)?>", 1)
    closed = F.contains("content", F.concat(F.lit("</"), root, F.lit(">")))
    return rows.select("path", "category", api_name(F.col("path")).alias("api_name"), "content", F.when((root == "") | ~closed, "not an XML document").alias("parse_error"))


def record_types(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch records from a JSON array: cmt_type, developer_name, fields as text."""
    return spark.read.schema("cmt_type string, developer_name string, fields map<string,string>").option("multiLine", "true").json(path)


def components(found: DataFrame) -> DataFrame:
    """All definitions as components: component_id, category, name, api_name, content_hash."""
    rows = categorised(found)
    files_ = rows.filter("category <> 'lwc_bundle'").select("category", api_name(F.col("path")).alias("api_name"), F.sha2("content", 256).alias("content_hash"))
    scripts = bundles(found).select(F.lit("lwc_bundle").alias("category"), "api_name", F.sha2(F.to_json("files"), 256).alias("content_hash"))
    every = files_.unionByName(scripts)
    return every.select(F.sha2(F.concat_ws("/", "category", "api_name"), 256).alias("component_id"), "category", F.col("api_name").alias("name"), "api_name", "content_hash")


def category_counts(found: DataFrame) -> DataFrame:
    """The categories with a file at least, and how many components each has."""
    return components(found).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
