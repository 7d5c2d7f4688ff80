"""Queries over definition files: scanning, telling kinds apart and normalising. The view ``defs`` makes a file of each
part, so the SQL knows from the part alone what each must give; two queries write files and scan them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.plans.registry import query
from cairnflow.session import shared_path
from cairnflow.sources import definitions as D

_KIND = """CASE CAST(p_partkey % 18 AS INT) WHEN 0 THEN 'validation_rule' WHEN 1 THEN 'formula_field' WHEN 2 THEN 'rollup_summary' WHEN 3 THEN 'workflow_rule' WHEN 4 THEN 'assignment_rule' WHEN 5 THEN 'record_triggered_flow' WHEN 6 THEN 'screen_flow'
    WHEN 7 THEN 'schedule_triggered_flow' WHEN 8 THEN 'platform_event_triggered_flow' WHEN 9 THEN 'flow_orchestration' WHEN 10 THEN 'process_builder' WHEN 11 THEN 'autolaunched_flow' WHEN 12 THEN 'sharing_rule' WHEN 13 THEN CASE WHEN p_size % 2 = 0 THEN 'platform_event' END
    WHEN 14 THEN 'lwc_bundle' WHEN 15 THEN 'apex_class' END"""
_NAME = """CASE CAST(p_partkey % 18 AS INT) WHEN 0 THEN 'V' || k WHEN 1 THEN 'F' || k || '__c' WHEN 2 THEN 'R' || k || '__c' WHEN 3 THEN 'W' || k WHEN 4 THEN 'A' || k WHEN 5 THEN 'N' || k WHEN 6 THEN 'S' || k WHEN 7 THEN 'T' || k WHEN 8 THEN 'E' || k
    WHEN 9 THEN 'O' || k WHEN 10 THEN 'P' || k WHEN 11 THEN 'L' || k WHEN 12 THEN 'H' || k WHEN 13 THEN 'Ev' || k || '__e' WHEN 14 THEN 'c' || k || '.js' WHEN 15 THEN 'C' || k END"""


def _found(defs: DataFrame) -> DataFrame:
    """The view's files, made once a row: behind a generator they are not written out again in each condition."""
    return defs.select(F.explode(F.array(F.struct("path", "content"))).alias("f")).select("f.*")


def _shown(entries) -> F.Column:
    return F.array_join(entries, ";")


@query(f"SELECT path, {_KIND} AS category, {_NAME} AS api_name, CASE WHEN p_partkey % 18 < 3 THEN 'Obj' || z WHEN p_partkey % 18 = 13 THEN 'Ev' || k || '__e' END AS sobject FROM defs WHERE {_KIND} IS NOT NULL", "defs")
def scan_categories(spark, defs):
    rows = D.categorised(_found(defs))
    return rows.select("path", "category", D.api_name(F.col("path")).alias("api_name"), D.object_of(F.col("path")).alias("sobject"))


_COMPONENTS = f"""m AS (SELECT {_KIND} AS category, {_NAME} AS api_name, sha256(content) AS content_hash FROM defs WHERE {_KIND} IS NOT NULL AND p_partkey % 18 <> 14
    UNION ALL SELECT 'lwc_bundle', 'b' || z, sha256('{{' || string_agg('"c' || k || '.js":"export ' || k || '"', ',' ORDER BY 'c' || k || '.js') || '}}') FROM defs WHERE p_partkey % 18 = 14 GROUP BY z)"""


@query(f"WITH {_COMPONENTS} SELECT sha256(category || '/' || api_name) AS component_id, category, api_name AS name, api_name, content_hash FROM m", "defs")
def scan_components(spark, defs):
    return D.components(_found(defs))


@query(f"WITH {_COMPONENTS} SELECT category, count(*) AS n FROM m GROUP BY 1", "defs")
def scan_list_categories(spark, defs):
    return D.category_counts(_found(defs))


@query("SELECT 'b' || z AS api_name, string_agg('c' || k || '.js=export ' || k, ';' ORDER BY 'c' || k || '.js') AS files FROM defs WHERE p_partkey % 18 = 14 GROUP BY z", "defs")
def scan_bundles(spark, defs):
    entries = F.transform(F.map_entries("files"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return D.bundles(_found(defs)).select("api_name", _shown(entries).alias("files"))


@query("""WITH c AS (SELECT unnest([{'path': '/flows/N' || k, 'priority': 2}, {'path': '/flows/N' || k, 'priority': 1}, {'path': '/flows/N' || z, 'priority': 1 + p_partkey}]) AS x FROM defs)
    SELECT x.path AS path, min(x.priority) AS priority FROM c GROUP BY 1""", "defs")
def scan_first_match(spark, defs):
    """A path that several kinds claim, or that is listed more than once, is one row: that of the first kind."""
    claims = F.expr("array(struct(concat('/flows/N', k) AS path, 2L AS priority), struct(concat('/flows/N', k) AS path, 1L AS priority), struct(concat('/flows/N', z) AS path, 1 + p_partkey AS priority))")
    claimed = defs.select(F.explode(claims).alias("x")).select("x.*")
    return D.first_match(claimed.distinct())


@query("""SELECT 'V' || k AS api_name, 'Obj' || z AS sobject, p_size % 3 <> 2 AS active, CASE WHEN p_size % 3 = 1 THEN 'd' ELSE '' END AS description, 'Amount < ' || z AS formula, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'too small' END AS message
    FROM defs WHERE p_partkey % 18 = 0""", "defs")
def normalise_validation(spark, defs):
    return D.validation_rules(_found(defs)).select("api_name", "sobject", "active", "description", "formula", "message")


@query("""SELECT 'F' || k || '__c' AS api_name, CASE WHEN p_size % 2 = 0 THEN 'G' || k ELSE 'F' || k || '__c' END AS field_name, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'L' END AS label, CASE WHEN p_size % 2 = 0 THEN 'Number' ELSE 'Formula' END AS type,
    'Amount / ' || z AS formula, CASE WHEN p_size % 2 = 0 THEN 'BlankAsZero' ELSE 'BlankAsBlank' END AS treat_blanks_as, CASE WHEN p_size % 2 = 0 THEN 'Number' ELSE 'Text' END AS return_type, p_size % 2 = 0 AS external_id FROM defs WHERE p_partkey % 18 = 1""", "defs")
def normalise_formula_field(spark, defs):
    return D.formula_fields(_found(defs)).drop("path", "sobject")


@query("""SELECT 'W' || k AS sobject, 'a/true/onCreateOnly/-/F' || z || ' equals 1' || CASE WHEN p_size % 2 = 0 THEN ',G  ' ELSE '' END || '/u FieldUpdate;b/false/onCreateOnly/TRUE//' AS rules, 'u/Status/' || z || '/-//false/' AS updates,
    CASE WHEN p_size % 5 = 0 THEN 'm' ELSE '' END AS alerts, 0 AS n_tasks FROM defs WHERE p_partkey % 18 = 3""", "defs")
def normalise_workflow(spark, defs):
    bar = lambda *xs: F.concat_ws("/", *(F.coalesce(x.cast("string"), F.lit("-")) for x in xs))
    items = lambda xs, *names: F.array_join(F.transform(xs, lambda c: F.concat_ws(" ", *(c[n] for n in names))), ",")
    rule = lambda r: bar(r["fullName"], r["active"], r["triggerType"], r["formula"], items(r["criteriaItems"], "field", "operation", "value"), items(r["actions"], "name", "type"))
    update = lambda u: bar(u["fullName"], u["field"], u["literalValue"], u["formula"], u["operation"], u["reevaluateOnChange"], u["targetObject"])
    rows = D.workflow_rules(_found(defs))
    return rows.select("sobject", _shown(F.transform("rules", rule)).alias("rules"), _shown(F.transform("field_updates", update)).alias("updates"), _shown(F.transform("alerts", lambda a: a["name"])).alias("alerts"), F.size("tasks").alias("n_tasks"))


@query("""SELECT 'A' || k AS sobject, 'g/true/q' || z || ' User -,u Queue X' || CASE WHEN p_size % 2 = 0 THEN ';h/false/' ELSE '' END AS groups FROM defs WHERE p_partkey % 18 = 4""", "defs")
def normalise_assignment(spark, defs):
    entry = lambda e: F.concat_ws(" ", e["assignedTo"], e["assignedToType"], F.coalesce(e["formula"], F.lit("-")))
    group = lambda g: F.concat_ws("/", g["name"], g["active"].cast("string"), F.array_join(F.transform(g["entries"], entry), ","))
    return D.assignment_rules(_found(defs)).select("sobject", _shown(F.transform("groups", group)).alias("groups"))


@query("""SELECT 'N' || k AS api_name, 'Obj' || z AS sobject, 'RecordAfterSave' AS trigger_type, 'AutoLaunchedFlow' AS process_type, 'Draft' AS status, '66.0' AS api_version, 2 AS decisions, 0 AS lookups, 2 AS dml, 0 AS screens, 'A=' || z || ';B=$r' AS sets FROM defs WHERE p_partkey % 18 = 5
    UNION ALL SELECT 'S' || k, '', '', 'Flow', 'Active', '66.0', 0, 0, 0, 1, '' FROM defs WHERE p_partkey % 18 = 6""", "defs")
def normalise_flow(spark, defs):
    found = _found(defs)
    both = D.flows(found, "record_triggered_flow").unionByName(D.flows(found, "screen_flow"))
    sets = F.transform("sets", lambda a: F.concat(a["field"], F.lit("="), a["value"]))
    return both.select("api_name", "sobject", "trigger_type", "process_type", "status", "api_version", "decisions", "lookups", "dml", "screens", _shown(sets).alias("sets"))


@query("SELECT 'H' || k AS api_name, content, p_size % 2 = 0 AS parsed FROM defs WHERE p_partkey % 18 = 12", "defs")
def normalise_passthrough(spark, defs):
    return D.passthrough(_found(defs), "sharing_rule").select("api_name", "content", F.col("parse_error").isNull().alias("parsed"))


def _written(spark: SparkSession, files: dict[str, str]) -> str:
    """A new folder that all executors see, with files of the given names and texts."""
    folder = shared_path(spark, "corpus")
    for name, text in files.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
    return folder


@query("""SELECT 'V' || n_nationkey AS api_name, 'Obj' || n_regionkey AS sobject, 'validation_rule' AS category, 'X = ' || n_nationkey AS formula FROM nation""", "nation")
def scan_folder(spark, nation):
    """A folder on the shared file system, with a file for each of the 25 nations and one of no kind."""
    files = {f"objects/Obj{r.n_regionkey}/validationRules/V{r.n_nationkey}.validationRule-meta.xml": f"<ValidationRule><errorConditionFormula>X = {r.n_nationkey}</errorConditionFormula></ValidationRule>" for r in nation.collect()}
    found = D.files(spark, _written(spark, files | {"readme.txt": "-"}))
    return D.validation_rules(found).select("api_name", "sobject", F.lit("validation_rule").alias("category"), "formula")


@query("SELECT 'Route' AS cmt_type, 'r' || n_nationkey AS developer_name, 'H' || n_regionkey AS handler, CAST(n_nationkey AS VARCHAR) AS place FROM nation", "nation")
def scan_record_types(spark, nation):
    import json

    records = [{"cmt_type": "Route", "developer_name": f"r{r.n_nationkey}", "fields": {"Handler": f"H{r.n_regionkey}", "Place": r.n_nationkey}} for r in nation.collect()]
    read = D.record_types(spark, _written(spark, {"custom_metadata.json": json.dumps(records)}))
    return read.select("cmt_type", "developer_name", F.col("fields")["Handler"].alias("handler"), F.col("fields")["Place"].alias("place"))
