"""Golden values of rules, change events, logs and graphs."""

import pytest
from pyspark.sql import functions as F

from cairnflow.functions import scalar as S
from cairnflow.operators import cdc, corpus, graph, logs, readiness, rules
from cairnflow.plans import reports


def opp(spark):
    return spark.createDataFrame([(1, 200.0, "US", "x"), (2, None, "EU", None), (3, 5.0, "AU", "y")], "id int, Amount double, Country string, Name string")


def test_pipeline_collects_failures_and_refires(spark):
    own = [
        rules.validation("v1", "Lead", "Amount < 10", "too small"), rules.validation("v2", "Lead", "ISBLANK(Name)", "no name"), rules.formula_field("f1", "Lead", "Big", "Amount * 2"),
        rules.workflow("Lead", [{"active": True, "criteria": [("Lead.Amount", "greaterThan", "100")], "actions": ["u1", "gone"]}], {"u1": {"field": "Status", "literal": "hot"}}),
        rules.assignment("a1", "Lead", [{"active": True, "entries": [{"criteria": [("Country", "equals", "US")], "owner": "us"}, {"criteria": [], "owner": "rest"}]}]),
        rules.flow("fl", "Lead", {"Seen": True}, "RecordBeforeSave"),
    ]
    got = {r.id: r for r in rules.run(opp(spark), own).collect()}
    assert [x.rule_id for x in got[1]._results] == ["fl", "f1", "v1", "v2", "a1", "Lead.workflow", "fl"]
    assert (got[1]._refired, got[1].Status, got[1].OwnerId, got[1].Big) == (True, "hot", "us", 400.0)
    assert got[2]._abort_reason == "validation failed: v1 error; no name" and got[2].OwnerId is None and got[2].Seen
    assert got[3]._aborted and got[3].Big == 10.0 and not got[3]._refired


def test_rules_see_what_earlier_ones_wrote(spark):
    own = [rules.formula_field("a", "X", "Amount", "Amount + 1"), rules.formula_field("b", "X", "Twice", "Amount * 2")]
    assert not rules.commuting(own)
    assert [r.Twice for r in rules.run(opp(spark), own).orderBy("id").collect()] == [402.0, None, 12.0]


def test_excluded_step_is_an_error(spark):
    with pytest.raises(rules.StepNotInScope):
        rules.run(opp(spark), [], excluded=(13,))
    with pytest.raises(ValueError, match="not compiled"):
        rules.flow("f", "X", {}, calls=1)


def test_shuffle_is_reproducible():
    assert rules.shuffled(["b", "a", "c"], 42, "t") == rules.shuffled(["c", "b", "a"], 42, "t")


def score(spark, rows):
    return readiness.readiness(spark.createDataFrame([("p", d, s) for d, s in rows], "process_id string, diverged boolean, severity int")).first()


@pytest.mark.parametrize(("rows", "want"), [([(False, 0)] * 5 + [(True, 50), (True, 80)], 62), ([(False, 0)] * 190 + [(True, 50)] * 10, 94), ([(False, 0)] * 160 + [(True, 80)] * 40, 72), ([(True, 80)] * 200, 60 - 60)])
def test_scores(spark, rows, want):
    assert score(spark, rows).score == want


def test_diff_ignores_empty(spark):
    df = spark.sql("SELECT map('Name', '', 'S', 'Approved') AS p, map('S', 'Pending') AS r").select(S.field_diff(F.col("p"), F.col("r")).alias("d"))
    assert {k: tuple(v) for k, v in df.first().d.items()} == {"S": ("Approved", "Pending")}


def test_categories_in_order(spark):
    base = {"gap": "UPDATE", "diffs": {"A": ("1", "2")}, "aborted": False, "reason": None, "o": False, "g": False, "t": False}
    cases = [
        ({"gap": "GAP_CREATE"}, "gap_event_full_refetch_required", 80), ({"diffs": {}}, None, 0), ({"aborted": True, "reason": "MixedDML x"}, "ooe_ordering_mismatch", 60), ({"aborted": True, "reason": "Cascade"}, "ooe_ordering_mismatch", 70),
        ({"aborted": True, "reason": "Validation"}, "translation_error", 50), ({}, "formula_edge_case", 40), ({"diffs": {"A": ("a", "b")}, "o": True}, "non_deterministic_trigger_ordering", 55), ({"diffs": {"A": ("a", "b")}, "g": True}, "governor_limit_behavior", 35),
        ({"diffs": {"A": ("a", "b")}, "t": True}, "test_environment_artifact", 10), ({"diffs": {"A": ("a", "b")}}, "translation_error", 50),
    ]
    rows = [tuple((base | c).values()) for c, _, _ in cases]
    df = spark.createDataFrame(rows, "gap string, diffs map<string,struct<production:string,runtime:string>>, aborted boolean, reason string, o boolean, g boolean, t boolean")
    got = df.select(S.categorise(F.col("gap"), F.lit("E"), F.col("diffs"), F.col("aborted"), F.col("reason"), F.col("o"), F.col("g"), F.col("t"), F.lit(None).cast("string")).alias("c")).collect()
    assert [(r.c.category, r.c.severity) for r in got] == [(c, s) for _, c, s in cases]


def test_resync_fails_a_chunk(spark):
    ids = [f"{k:015d}" for k in range(250)] + ["zz bad"]
    asked = spark.createDataFrame([("A", i) for i in ids], "sobject string, record_id string")
    snapshot = asked.limit(0).withColumn("fields", F.create_map(F.lit("a"), F.lit("b")))
    got = {r.outcome: r.n for r in cdc.resync(asked, snapshot).groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert got == {"deleted": 200, "failed": 51}


def test_reconcile_prefers_by_source(spark):
    rows = [("sf_cli", "c", "n", None, {"m": "cli", "x": "1"}), ("salto", "c", "n", None, {"m": "salto"})]
    df = spark.createDataFrame(rows, "source string, category string, api_name string, namespace string, payload map<string,string>")
    r = corpus.reconcile(df).first()
    assert r.payload == {"m": "salto", "x": "1"} and r.sources == ["salto", "sf_cli"]
    (d,) = corpus.disagreements(df).collect()
    assert (d.field, d.source, d.winner, d.values_by_source) == ("m", "sf_cli", "salto", {"salto": "salto", "sf_cli": "cli"})


LOG = """10:00:00.1 (1)|EXECUTION_STARTED
10:00:00.2 (2)|USER_INFO|[EXTERNAL]|005000000000001|x
10:00:00.3 (3)|DML_BEGIN|[12]|Op:Insert|Type:Lead|Rows:1
10:00:00.4 (4)|VALIDATION_RULE|r
10:00:00.5 (5)|VALIDATION_FAIL|abc Name:Email_Required
10:00:00.6 (6)|FLOW_START_INTERVIEW_BEGIN|id|LeadRouting
10:00:00.7 (7)|DML_END|[12]
10:00:00.8 (8)|EXECUTION_FINISHED"""


def test_log(spark):
    lines = spark.createDataFrame([("f", k, v) for k, v in enumerate([*LOG.split("\n"), "no time"])], "file string, line_no int, value string")
    kinds = logs.classify(lines)
    assert tuple(logs.parse_stats(kinds).first())[1:] == (8, 1)
    (t,) = logs.transactions(logs.sessions(kinds)).collect()
    assert (t.n_events, t.n_dml, t.failures, t.flows, t.user_id) == (7, 1, ["Email_Required"], ["LeadRouting"], "005000000000001")


def test_log_lines_of_unknown_kinds_are_not_classified(spark):
    rows = ["10:00:00.1 (1)|EXECUTION_STARTED", "10:00:00.2 (2)|HEAP_DUMP|x", "10:00:00.3 (3)|VALIDATION_PASS", "10:00:00.4 (4)|EXECUTION_FINISHED"]
    kinds = logs.classify(spark.createDataFrame([("f", k, v) for k, v in enumerate(rows)], "file string, line_no int, value string"))
    assert tuple(logs.parse_stats(kinds).first()) == ("f", 3, 1)
    assert logs.transactions(logs.sessions(kinds)).first().n_events == 2
    assert logs.classify(kinds.sparkSession.createDataFrame([("f", 1, "10:00:00.1 (1)|OTHER")], "file string, line_no int, value string")).first().kind is None


def test_includes_is_containment(spark):
    from cairnflow.functions import formula as L
    from cairnflow.operators import rules

    df = spark.createDataFrame([("a;bc",), ("b",), (None,)], "v string")
    hit = L.truthy(rules.conjunction(rules.Record(df.schema), [("v", "includes", "b")]))
    assert [r.hit for r in df.select(hit.alias("hit")).collect()] == [True, True, False]


def test_numbers_over_ranges(spark):
    from cairnflow.operators import graph

    df = spark.range(500).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 5).alias("g"))
    got = graph.numbered(df, F.col("g").desc(), F.col("k").asc()).collect()
    want = sorted(df.collect(), key=lambda r: (-r.g, r.k))
    assert sorted((r.number, r.g, r.k) for r in got) == [(n + 1, r.g, r.k) for n, r in enumerate(want)]


def admitted(requests, budgets):
    """Plain fold of (process_id, seq, cost) over each process's budget."""
    left, out = dict(budgets), {}
    for process, seq, cost in sorted(requests):
        out[process, seq] = cost <= left.get(process, 0)
        left[process] = left.get(process, 0) - cost * out[process, seq]
    return out


def test_every_request_is_decided(spark, sf):
    from cairnflow.plans import catalogue
    from cairnflow.sources.views import view

    most = {}
    for r in view(spark, sf, "requests").collect():
        most[r.process_id, r.seq] = max(most.get((r.process_id, r.seq), 0), r.cost)
    budgets = {r.process_id: r.remaining_for for r in readiness.quota(view(spark, sf, "alloc"), 300).collect()}
    got = {(r.process_id, r.seq): r.admitted for r in catalogue.QUERIES["quota_sequential"](spark, sf).collect()}
    assert got == admitted([(*k, c) for k, c in most.items()], budgets) and len(set(got.values())) == 2


def test_requests_of_a_hot_process(spark):
    rows = [("hot", k * 7919 % 100_003, k % 7 + 1) for k in range(100_000)] + [("cold", 1, 5), ("none", 2, 1)]
    shares = spark.createDataFrame([("hot", 90_000), ("cold", 4)], "process_id string, remaining_for long")
    found = readiness.admit(spark.createDataFrame(rows, "process_id string, seq long, cost long"), shares).collect()
    got = {(r.process_id, r.seq): r.admitted for r in found}
    assert len(found) == len(rows) and got == admitted(rows, {"hot": 90_000, "cold": 4})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "src long, dst long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_graph_queries_take_every_edge(spark, sf):
    from cairnflow.plans import catalogue
    from cairnflow.sources.views import view

    edges = {(r.l_partkey, r.l_partkey + r.l_linenumber) for r in view(spark, sf, "lineitem").select("l_partkey", "l_linenumber").collect()}
    label = {x: x for e in edges for x in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in catalogue.QUERIES["graph_components"](spark, sf).collect()}
    assert got == label and len(label) > 10 * len(set(label.values()))
    assert {r.node for r in catalogue.QUERIES["graph_communities"](spark, sf).collect()} == set(label)
    assert catalogue.QUERIES["business_processes"](spark, sf).agg(F.sum("size")).first()[0] == len(label)


def test_communities_of_two_cliques(spark):
    cliques = [(a, b) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)]
    got = {r.node: r.community for r in graph.communities(spark.createDataFrame([*cliques, (0, 10)], "src long, dst long"), rounds=20).collect()}
    assert len({got[k] for k in range(5)}) == 1 and len({got[k] for k in range(10, 15)}) == 1 and got[1] != got[11]


def test_reports(spark, sf):
    from cairnflow.plans.catalogue import NOW, _attempts
    from cairnflow.sources.views import view

    comp = view(spark, sf, "comp")
    report = reports.corpus_report(comp, _attempts(comp))
    assert len(report["steps"]) == 21 and len(report["components"]) == 200
    assert "<table>" in reports.page("x", coverage=report["coverage"])
    board = reports.shadow_dashboard(view(spark, sf, "obs"), NOW)
    assert len(board["recent"]) == 200 and len(board["scores"]) == 5
    assert len(reports.compliance(view(spark, sf, "obs"), "p1", NOW)["score"]) == 1


def test_names_within_bodies(spark):
    names = ["Ab", "b", "Cls_1", "lass", "a b", "x.y", "", "zz", "longer than any body at all", None]
    bodies = ["call Class()", "x.yAbc a b", None, "", "Cls_"]
    made = corpus.orphans_contained(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(b,) for b in bodies], "body string"))
    want = [n for n in names if n is None or not any(b is not None and n in b for b in bodies)]
    assert sorted((r.name for r in made.collect()), key=str) == sorted(want, key=str)
    assert corpus.orphans_contained(spark.createDataFrame([], "name string"), spark.createDataFrame([("a",)], "body string")).count() == 0


def test_resync_numbers_each_object(spark):
    requested = [(o, f"{o}{k * 7919 % 1009:014d}") for o, n in (("A", 701), ("B", 3)) for k in range(n)]
    made = cdc.resync(spark.createDataFrame(requested * 2, "sobject string, record_id string"), spark.createDataFrame([], "sobject string, record_id string, fields map<string,string>"))
    want = {(o, i): k // 200 for o in "AB" for k, i in enumerate(sorted(i for p, i in requested if p == o))}
    assert {(r.sobject, r.record_id): r.chunk for r in made.collect()} == want and made.count() == len(requested)
