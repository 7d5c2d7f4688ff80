"""Corpus scanning and change events, from files made here."""

from cairnflow.operators import cdc
from cairnflow.sources import changes, definitions
from cairnflow.streaming import shadow

X = '<?xml version="1.0"?><{0} xmlns="urn:x">{1}</{0}>'
FILES = {
    "objects/Deal/validationRules/Must.validationRule-meta.xml": X.format("ValidationRule", "<fullName>Must</fullName><active>false</active><errorConditionFormula>ISBLANK(Name)</errorConditionFormula><errorMessage>no</errorMessage>"),
    "objects/Deal/fields/K__c.field-meta.xml": X.format("CustomField", "<fullName>K__c</fullName><type>Number</type><formula>Amount / 10</formula>"),
    "objects/Deal/fields/N__c.field-meta.xml": X.format("CustomField", "<fullName>N__c</fullName><summaryOperation>count</summaryOperation>"),
    "workflows/Deal.workflow-meta.xml": X.format("Workflow", "<rules><fullName>R</fullName><active>true</active><criteriaItems><field>Deal.Amount</field><operation>greaterThan</operation><value>5</value></criteriaItems><actions><name>U</name><type>FieldUpdate</type></actions></rules><fieldUpdates><fullName>U</fullName><field>Status</field><literalValue>hot</literalValue></fieldUpdates>"),
    "flows/F.flow-meta.xml": X.format("Flow", "<processType>AutoLaunchedFlow</processType><start><object>Deal</object><triggerType>RecordAfterSave</triggerType></start><recordUpdates><name>u</name><inputAssignments><field>Rank</field><value><numberValue>3</numberValue></value></inputAssignments></recordUpdates><decisions><name>d</name></decisions>"),
    "flows/G.flow-meta.xml": X.format("Flow", "<processType>Flow</processType><screens><name>s</name></screens>"),
    "lwc/card/card.js": "import a from '@host/apex/Svc.run';\nif (x) { fetch('u') }",
    "lwc/card/card.html": "<template/>",
    "sharingRules/Deal.sharingRules-meta.xml": "broken <x",
}


def corpus(spark, folder):
    for name, text in FILES.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    return definitions.files(spark, str(folder))


def test_scan(spark, tmp_path):
    found = corpus(spark, tmp_path)
    assert {r.category: r.n for r in definitions.category_counts(found).collect()} == {
        "validation_rule": 1, "formula_field": 1, "rollup_summary": 1, "workflow_rule": 1, "record_triggered_flow": 1, "screen_flow": 1, "lwc_bundle": 1, "sharing_rule": 1,
    }
    (v,) = definitions.validation_rules(found).collect()
    assert (v.api_name, v.sobject, v.active, v.formula, v.message) == ("Must", "Deal", False, "ISBLANK(Name)", "no")
    (f,) = definitions.formula_fields(found).collect()
    assert (f.api_name, f.formula, f.label) == ("K__c", "Amount / 10", "")
    (w,) = definitions.workflow_rules(found).collect()
    assert w.rules[0].criteriaItems[0].operation == "greaterThan" and w.field_updates[0].literalValue == "hot" and w.alerts == []
    (r,) = definitions.flows(found, "record_triggered_flow").collect()
    assert (r.sobject, r.decisions, r.dml, r.screens, r.sets[0].value) == ("Deal", 1, 1, 0, "3")
    (b,) = definitions.bundles(found).collect()
    assert sorted(b.files) == ["card.html", "card.js"]
    assert definitions.passthrough(found, "sharing_rule").first().parse_error


def recorded(folder):
    r = changes.Recorder()
    r.register("Account", ["Name", "Industry"])
    at = "2024-01-01T00:0{}:00Z".format
    r.add("CREATE", "Account", "001A", at(0), Name="Acme", Industry="Tech")
    r.add("UPDATE", "Account", "001A", at(1), Industry="Finance")
    r.add("CREATE", "Account", "001B", at(2), Name="B")
    r.add("GAP_UPDATE", "Account", "001A", at(3))
    r.add("DELETE", "Account", "001B", at(4))
    r.write(str(folder))


def record_rules():
    """Made here so that they travel to the workers by value."""
    return [lambda r: {"Score": "1"} if r.get("Industry") == "Tech" else None, lambda r: None if r.get("Name") else "no name"]


def test_update_clears_absent_fields_and_gap_keeps_state(spark, tmp_path):
    recorded(tmp_path / "in")
    state = cdc.last_state(changes.read(spark, str(tmp_path / "in"))).collect()
    assert [(r.record_id, r.fields) for r in state] == [("001A", {"Name": None, "Industry": "Finance"})]


def test_stream_equals_batch(spark, tmp_path):
    recorded(tmp_path / "in")
    rules = record_rules()
    batch = shadow.shadow_batch(changes.read(spark, str(tmp_path / "in")), rules).orderBy("replay_id").collect()
    stream = shadow.shadow_stream(changes.read_stream(spark, str(tmp_path / "in")), rules)
    shadow.run_once(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert spark.read.parquet(str(tmp_path / "out")).orderBy("replay_id").collect() == batch
    assert [(r.category, r.severity) for r in batch] == [("formula_edge_case", 40), ("translation_error", 50), (None, 0), ("gap_event_full_refetch_required", 80), ("translation_error", 50)]
    assert batch[3].state == {"Name": None, "Industry": "Finance", "Id": "001A", "Score": "1"}


def test_topics(spark, tmp_path):
    recorded(tmp_path / "in")
    assert changes.read(spark, str(tmp_path / "in"), ["/data/LeadChangeEvent"]).count() == 0
    assert changes.read(spark, str(tmp_path / "in"), []).count() == 5
    assert changes.schema_id("A", {"b": "string", "a": "int"}) == changes.schema_id("A", {"a": "int", "b": "string"})


def test_kinds_of_flows(spark):
    text = {"a": "<processType>Flow</processType><screens/>", "b": "<processType>Flow</processType>", "c": "<processType>AutoLaunchedFlow</processType>", "d": "<processType>AutoLaunchedFlow</processType><screens>", "e": "<processType>Orchestrator</processType><triggerType>RecordAfterSave", "f": ""}
    rows = spark.createDataFrame([(f"/x/flows/{n}.flow-meta.xml", t) for n, t in text.items()], "path string, content string")
    got = {r.path[9:10]: r.category for r in definitions.categorised(rows).collect()}
    assert got == {"c": "autolaunched_flow", "e": "record_triggered_flow"}
    rows = spark.createDataFrame([("/x/flows/g.flow-meta.xml", "<processType>Flow</processType><screens>")], "path string, content string")
    assert definitions.categorised(rows).first().category == "screen_flow"


def test_absent_elements_and_either_spelling_of_entries(spark):
    rows = spark.createDataFrame([("/x/assignmentRules/A.assignmentRules-meta.xml", X.format("AssignmentRules", "<assignmentRule><ruleEntry><assignedTo>q</assignedTo></ruleEntry></assignmentRule>")), ("/x/assignmentRules/B.assignmentRules-meta.xml", "<AssignmentRules/>"), ("/x/workflows/W.workflow-meta.xml", "<Workflow/>")], "path string, content string")
    got = {r.sobject: r.groups for r in definitions.assignment_rules(rows).collect()}
    assert got["B"] == [] and [(g.name, g.active, [(e.assignedTo, e.assignedToType, e.formula, e.criteriaItems) for e in g.entries]) for g in got["A"]] == [("", True, [("q", "User", None, [])])]
    (w,) = definitions.workflow_rules(rows).collect()
    assert (w.sobject, w.rules, w.field_updates, w.alerts, w.tasks, w.messages) == ("W", [], [], [], [], [])
