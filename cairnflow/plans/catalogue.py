"""Every operator as a named query over the driver tables, with the SQL that it is compared with; those over
definition files are in ``scans``."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow import model as M
from cairnflow.functions import formula as L
from cairnflow.functions import scalar as S
from cairnflow.operators import cdc, corpus, graph, logs, readiness, rules
from cairnflow.plans import scans  # noqa: F401  registers its queries
from cairnflow.plans.registry import NOW, QUERIES, SQL, query  # noqa: F401
from cairnflow.session import SETTINGS, shared_path
from cairnflow.sources import changes
from cairnflow.streaming import shadow

def joined(c) -> F.Column:
    return F.array_join(c, ",")


# --- readiness --------------------------------------------------------------------------------------------------

_SUMS = "count(*) AS t, count(*) FILTER (diverged) AS d, CAST(coalesce(sum(severity) FILTER (diverged), 0) AS BIGINT) AS s"
_SCORE = "CAST(greatest(0.0, least(100.0, round_even(CAST(100 AS DOUBLE) * (t - d) / t - CAST(0.5 AS DOUBLE) * s / t, 0))) AS INT)"
_READY = """g AS (SELECT {by}, {sums} FROM {src} GROUP BY ALL), r AS (SELECT *, {score} AS score FROM g)
    SELECT {by}, t AS total_events, t - d AS clean_events, d AS diverged_events, CASE WHEN d > 0 THEN s / CAST(d AS DOUBLE) ELSE 0.0::DOUBLE END AS avg_severity, score,
    t >= 100 AND score >= 98 AS eligible, CASE WHEN t < 100 THEN 'only ' || t || ' events in 30-day window; need 100 for eligibility'
    WHEN score < 98 THEN 'score ' || score || ' < threshold 98' ELSE 'score ' || score || ' >= 98 on ' || t || ' events' END AS reason FROM r"""


def _ready(by: str = "process_id", src: str = "obs") -> str:
    return "WITH " + _READY.format(by=by, src=src, sums=_SUMS, score=_SCORE)


@query(_ready(), "obs")
def readiness_score(spark, obs):
    return readiness.readiness(obs)


@query(_ready(src="obs_mild"), "obs_mild")
def readiness_eligible(spark, obs):
    return readiness.readiness(obs)


@query(_ready("event_type"), "obs")
def readiness_by_type(spark, obs):
    return readiness.readiness(obs, "event_type")


@query(_ready(src="(SELECT * FROM obs WHERE observed_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY)"), "obs")
def readiness_window(spark, obs):
    return readiness.readiness(readiness.in_window(obs, NOW, 14))


@query(f"""WITH day AS (SELECT process_id, CAST(observed_at AS DATE) AS day, {_SUMS} FROM obs GROUP BY ALL),
    w AS (SELECT process_id, day, sum(t) OVER f AS t, sum(d) OVER f AS d, sum(s) OVER f AS s FROM day WINDOW f AS (PARTITION BY process_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW))
    SELECT process_id, CAST(day AS VARCHAR) AS day, CAST(t AS BIGINT) AS total_events, CAST(d AS BIGINT) AS diverged_events, {_SCORE} AS score FROM w""", "obs")
def readiness_rolling_30d(spark, obs):
    return readiness.rolling(obs).withColumn("day", F.col("day").cast("string"))


@query("SELECT process_id, (count(*) - count(*) FILTER (diverged)) / CAST(count(*) AS DOUBLE) AS clean_rate FROM obs GROUP BY 1", "obs")
def readiness_clean_rate(spark, obs):
    return readiness.readiness(obs).select("process_id", (F.col("clean_events") / F.col("total_events")).alias("clean_rate"))


@query(f"WITH g AS (SELECT process_id, {_SUMS} FROM obs_mild GROUP BY 1) SELECT process_id, {_SCORE} AS score FROM g ORDER BY score, process_id", "obs_mild")
def readiness_ascending(spark, obs):
    return readiness.readiness(obs).select("process_id", "score").orderBy("score", "process_id")


@query("SELECT process_id, epoch_us(max(observed_at)) AS last_us, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(observed_at))) / CAST(3600000000 AS DOUBLE) AS lag_hours, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(observed_at))) > 60 * 3600000000 AS needs_reconciliation FROM obs WHERE process_id <> 'p0' OR observed_at < TIMESTAMP '2024-01-20' GROUP BY 1", "obs")
def lag_snapshot(spark, obs):
    rows = obs.filter("process_id <> 'p0' OR observed_at < TIMESTAMP_NTZ '2024-01-20'")
    return readiness.lag(rows, NOW).select("process_id", F.unix_micros(F.col("last_event_at").cast("timestamp")).alias("last_us"), "lag_hours", "needs_reconciliation")


@query("SELECT id, process_id, severity FROM obs WHERE diverged ORDER BY observed_at DESC, id DESC LIMIT 200", "obs")
def divergence_recent_topk(spark, obs):
    return readiness.newest(obs.filter("diverged"), 200, "observed_at", "id").select("id", "process_id", "severity")


@query("SELECT CASE WHEN severity < 35 THEN 'b-low' WHEN severity < 70 THEN 'b-med' ELSE 'b-high' END AS band, count(*) AS n FROM obs WHERE diverged GROUP BY 1", "obs")
def divergence_severity_bands(spark, obs):
    return obs.filter("diverged").groupBy(S.band(F.col("severity")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT event_type, severity, row_number() OVER (PARTITION BY event_type ORDER BY severity) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM obs)
    SELECT event_type, max(severity) FILTER (i = least(floor(n * 50 / 100.0), n - 1)) AS p50, max(severity) FILTER (i = least(floor(n * 99 / 100.0), n - 1)) AS p99 FROM c GROUP BY 1""", "obs")
def latency_percentiles(spark, obs):
    return readiness.nearest_rank(obs, "severity", [50, 99], ["event_type"])


# --- routing and control ----------------------------------------------------------------------------------------

_SCORES = f"sc AS (SELECT n_name AS process_id, CAST(80 + n_nationkey % 21 AS INT) AS score, n_nationkey % 2 = 0 OR n_nationkey > 15 AS eligible FROM nation WHERE n_nationkey <> 7)"


def _scores(nation):
    return nation.filter("n_nationkey <> 7").selectExpr("n_name AS process_id", "CAST(80 + n_nationkey % 21 AS INT) AS score", "n_nationkey % 2 = 0 OR n_nationkey > 15 AS eligible")


_NEXT = "CASE stage_percent WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 5 THEN 25 WHEN 25 THEN 50 WHEN 50 THEN 100 WHEN 100 THEN NULL ELSE 1 END"
_PREV = "CASE stage_percent WHEN 1 THEN 0 WHEN 5 THEN 1 WHEN 25 THEN 5 WHEN 50 THEN 25 WHEN 100 THEN 50 ELSE 0 END"
_DWELL = "CASE stage_percent WHEN 1 THEN 48 WHEN 5 THEN 24 WHEN 25 THEN 12 WHEN 50 THEN 6 ELSE 0 END"
_BUCKET = "CAST(('0x' || substr(md5(hash_seed || ':' || process_id || ':' || record_id), 1, 8))::BIGINT % 100 AS INT)"


@query(f"""WITH j AS (SELECT t.process_id, record_id, stage_percent, {_BUCKET} AS b FROM traffic t JOIN cfg USING (process_id))
    SELECT process_id, record_id, CASE WHEN b < stage_percent THEN 'runtime' ELSE 'production' END AS routed_to, stage_percent FROM j""", "traffic", "cfg")
def route_md5(spark, traffic, cfg):
    return readiness.route(traffic, cfg)


@query(None, "traffic", "cfg")
def route_blake2b(spark, traffic, cfg):
    return readiness.route(traffic, cfg, S.bucket_blake2b)


@query("SELECT process_id, CAST(1 AS INT) AS stage_percent, process_id AS hash_seed FROM cfg", "cfg")
def begin_routing(spark, cfg):
    return readiness.begin(cfg.select("process_id"), NOW).select("process_id", "stage_percent", "hash_seed")


@query(f"SELECT process_id, CAST({_NEXT} AS INT) AS next_stage, CAST({_PREV} AS INT) AS previous_stage FROM cfg", "cfg")
def stage_next_prev(spark, cfg):
    return cfg.select("process_id", S.next_stage(F.col("stage_percent")).alias("next_stage"), S.previous_stage(F.col("stage_percent")).alias("previous_stage"))


@query(f"SELECT process_id, CAST(greatest({_DWELL} * 3600.0 - 36000.0, 0) AS DOUBLE) AS remaining_s FROM cfg", "cfg")
def dwell_remaining(spark, cfg):
    now = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")
    return cfg.select("process_id", S.dwell_remaining_s(F.col("stage_percent"), F.col("entered_stage_at"), now).alias("remaining_s"))


@query(f"""WITH {_SCORES}, j AS (SELECT process_id, coalesce(stage_percent, 0) AS pct, coalesce(score, 0) AS score, coalesce(eligible, false) AS eligible, {_NEXT} AS nxt, {_PREV} AS prv, {_DWELL} * 3600.0 <= 36000.0 AS done FROM cfg LEFT JOIN sc USING (process_id)),
    k AS (SELECT *, CASE WHEN score < 90 THEN 'immediate_rollback' WHEN score < 95 AND pct > 0 THEN 'rollback' WHEN score >= 98 AND done AND nxt IS NOT NULL AND eligible THEN 'advance' ELSE 'hold' END AS kind FROM j)
    SELECT process_id, CAST(pct AS INT) AS from_percent, CAST(score AS INT) AS readiness_score, kind, CAST(CASE kind WHEN 'immediate_rollback' THEN 0 WHEN 'rollback' THEN prv WHEN 'advance' THEN nxt ELSE pct END AS INT) AS to_percent,
    CASE kind WHEN 'immediate_rollback' THEN 'score ' || score || ' < immediate_rollback_threshold 90; requires human sign-off' WHEN 'rollback' THEN 'score ' || score || ' < rollback_threshold 95; reverting to ' || prv || '%'
    WHEN 'advance' THEN 'score ' || score || ' >= 98 + dwell complete' ELSE CASE WHEN nxt IS NULL THEN 'already at 100%' WHEN score < 98 THEN 'score ' || score || ' < advance_threshold 98' WHEN NOT done THEN 'dwell incomplete' ELSE 'not cutover-eligible per readiness scorer' END END AS reason,
    kind = 'immediate_rollback' AS requires_human_signoff FROM k""", "cfg", "nation")
def transition_decision(spark, cfg, nation):
    return readiness.decide(cfg, _scores(nation), "2024-01-01 10:00:00")


@query(f"""WITH {_SCORES}, j AS (SELECT process_id, stage_percent, hash_seed, coalesce(score, 0) AS score, coalesce(eligible, false) AS eligible, {_NEXT} AS nxt, {_PREV} AS prv, {_DWELL} * 3600.0 <= 36000.0 AS done FROM cfg LEFT JOIN sc USING (process_id))
    SELECT process_id, CAST(CASE WHEN score < 90 THEN CASE WHEN process_id = 'NATION_2' THEN 0 ELSE stage_percent END WHEN score < 95 AND stage_percent > 0 THEN prv WHEN score >= 98 AND done AND nxt IS NOT NULL AND eligible THEN nxt ELSE stage_percent END AS INT) AS stage_percent, hash_seed FROM j""", "cfg", "nation")
def transition_apply(spark, cfg, nation):
    decisions = readiness.decide(cfg, _scores(nation), "2024-01-01 10:00:00")
    return readiness.apply_decisions(cfg, decisions, NOW, ["NATION_2"]).select("process_id", "stage_percent", "hash_seed")


@query("SELECT process_id, CAST(CASE WHEN process_id IN ('NATION_3', 'NATION_4') THEN 0 ELSE stage_percent END AS INT) AS stage_percent FROM cfg", "cfg")
def instant_rollback(spark, cfg):
    return readiness.instant_rollback(cfg, ["NATION_3", "NATION_4"], NOW).select("process_id", "stage_percent")


@query(f"WITH {_SCORES} SELECT process_id, stage_percent, score FROM cfg JOIN sc USING (process_id) WHERE stage_percent = 100 AND score < 95", "cfg", "nation")
def regression_alert(spark, cfg, nation):
    return readiness.regressions(cfg, _scores(nation)).select("process_id", "stage_percent", "score")


_SHARE = "sh AS (SELECT process_id, consumed, 50000 * (weight / sum(weight) OVER ()) AS part FROM alloc)"


@query(f"WITH {_SHARE} SELECT process_id, CAST(floor(part) AS BIGINT) AS share, CAST(greatest(floor(part) - consumed, 0) AS BIGINT) AS remaining_for, consumed / part AS utilization FROM sh", "alloc")
def quota_share(spark, alloc):
    return readiness.quota(alloc, 50000)


@query("""WITH sh AS (SELECT process_id, greatest(floor(2000 * (weight / sum(weight) OVER ())) - consumed, 0) AS r FROM alloc), n AS (SELECT process_id, seq, row_number() OVER (PARTITION BY process_id ORDER BY seq) AS k FROM (SELECT DISTINCT process_id, seq FROM requests))
    SELECT n.process_id, seq, k <= coalesce(r, 0) AS admitted FROM n LEFT JOIN sh USING (process_id)""", "requests", "alloc")
def quota_admission(spark, requests, alloc):
    return readiness.admit_units(requests.select("process_id", "seq").distinct(), readiness.quota(alloc, 2000))


@query("""WITH RECURSIVE sh AS (SELECT process_id, CAST(greatest(floor(300 * (weight / sum(weight) OVER ())) - consumed, 0) AS BIGINT) AS r FROM alloc),
    n AS MATERIALIZED (SELECT process_id, seq, cost, row_number() OVER (PARTITION BY process_id ORDER BY seq, cost) AS k FROM (SELECT process_id, seq, max(cost) AS cost FROM requests GROUP BY 1, 2)),
    f AS (SELECT process_id, 0::BIGINT AS k, CAST(NULL AS BIGINT) AS seq, r AS budget, false AS admitted FROM sh UNION ALL
      SELECT n.process_id, n.k, n.seq, CASE WHEN cost <= budget THEN budget - cost ELSE budget END, cost <= budget FROM f JOIN n ON n.process_id = f.process_id AND n.k = f.k + 1)
    SELECT process_id, seq, admitted FROM f WHERE k > 0""".replace("WITH RECURSIVE", "WITH"), "requests", "alloc")
def quota_sequential(spark, requests, alloc):
    return readiness.admit(requests.groupBy("process_id", "seq").agg(F.max("cost").alias("cost")), readiness.quota(alloc, 300))


SQL["quota_sequential"] = SQL["quota_sequential"].replace("WITH requests", "WITH RECURSIVE requests", 1)


_SAGA = """g AS (SELECT DISTINCT ON (saga_id, seq) * FROM saga ORDER BY saga_id, seq, kind, has_fn, raises), o AS (SELECT *, coalesce(bool_or(kind = 'requires_human') OVER (PARTITION BY saga_id ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM g),
    r AS (SELECT saga_id, seq, kind, CASE WHEN stopped THEN 'pending' WHEN kind = 'requires_human' THEN 'paused' WHEN kind = 'log_only' THEN 'ok' WHEN NOT has_fn OR raises THEN 'failed' ELSE 'ok' END AS outcome FROM o)"""


def _saga(saga):
    return saga.groupBy("saga_id", "seq").agg(F.min(F.struct("kind", "has_fn", "raises")).alias("s")).select("saga_id", "seq", "s.*")


@query(f"WITH {_SAGA} SELECT * FROM r", "saga")
def saga_compensation(spark, saga):
    return readiness.compensate(_saga(saga))


@query(f"WITH {_SAGA} SELECT saga_id, count(*) FILTER (outcome = 'ok') AS n_ok, count(*) FILTER (outcome = 'failed') AS n_failed, bool_or(outcome = 'paused') AS paused, bool_and(outcome = 'ok') AS fully_compensated FROM r GROUP BY 1", "saga")
def saga_outcome(spark, saga):
    return readiness.saga_outcomes(readiness.compensate(_saga(saga)))


@query("""WITH u AS (SELECT 'category' AS dimension, category AS value, 1 AS n FROM findings UNION ALL SELECT 'disposition', customer_disposition, 1 FROM findings UNION ALL SELECT 'severity', severity, 1 FROM findings
    UNION ALL SELECT 'category', unnest(['deliberate_simplification', 'discovered_undocumented', 'platform_imposed_deviation', 'customer_requested_improvement']), 0)
    SELECT dimension, value, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY 1, 2""", "findings")
def parity_counts(spark, findings):
    return readiness.parity_counts(findings)


# --- change events ----------------------------------------------------------------------------------------------


def _events(cdc_rows):
    fields = F.create_map(F.lit("Amount"), F.col("amount").cast("string"), F.lit("Status"), F.col("status"))
    return cdc_rows.withColumn("fields", fields)


_LAST = "SELECT DISTINCT ON (sobject, record_id) * FROM cdc WHERE NOT starts_with(change_type, 'GAP_') ORDER BY sobject, record_id, replay_id DESC"


@query("SELECT replay_id, sobject, record_id FROM cdc WHERE starts_with(change_type, 'GAP_')", "cdc")
def gap_events(spark, rows):
    return cdc.gaps(rows).select("replay_id", "sobject", "record_id")


@query("SELECT replay_id, '/data/' || sobject || 'ChangeEvent' AS topic FROM cdc WHERE sobject IN ('Lead', 'Account')", "cdc")
def topic_filter(spark, rows):
    return cdc.subscribed(rows, ["/data/LeadChangeEvent", "/data/AccountChangeEvent"]).select("replay_id", cdc.topic(F.col("sobject")).alias("topic"))


@query("SELECT process_id, max_by(replay_id, replay_id) AS latest_replay_id, epoch_us(max(commit_ts)) AS last_us FROM cdc GROUP BY 1", "cdc")
def replay_checkpoint(spark, rows):
    done = cdc.checkpoint(rows.withColumn("processed_at", F.col("replay_id")), "processed_at")
    last = rows.groupBy("process_id").agg(F.unix_micros(F.max("commit_ts").cast("timestamp")).alias("last_us"))
    return done.select("process_id", "latest_replay_id").join(last, "process_id")


@query(f"WITH l AS ({_LAST}) SELECT sobject, record_id, change_type, CAST(amount AS VARCHAR) AS amount, status FROM l", "cdc")
def cdc_last_state(spark, rows):
    return cdc.last_state(_events(rows), keep_deleted=True).select("sobject", "record_id", "change_type", F.col("fields")["Amount"].alias("amount"), F.col("fields")["Status"].alias("status"))


@query(f"WITH l AS ({_LAST}) SELECT sobject, record_id, CAST(amount AS VARCHAR) AS amount, replay_id FROM l WHERE change_type <> 'DELETE'", "cdc")
def cdc_state_after_deletes(spark, rows):
    return cdc.last_state(_events(rows)).select("sobject", "record_id", F.col("fields")["Amount"].alias("amount"), "replay_id")


@query("SELECT event_id, CAST(amount AS VARCHAR) AS amount, status, record_id AS id, 'kept' AS extra FROM cdc", "cdc")
def cdc_overlay_merge(spark, rows):
    state = F.create_map(F.lit("Amount"), F.lit("old"), F.lit("Extra"), F.lit("kept"), F.lit("Id"), F.lit("x"))
    after = _events(rows).withColumn("after", cdc.overlay(state, F.col("fields"), F.col("record_id")))
    return after.select("event_id", *(F.col("after")[k].alias(n) for k, n in (("Amount", "amount"), ("Status", "status"), ("Id", "id"), ("Extra", "extra"))))


def _snapshot(rows):
    return rows.filter("event_id % 3 = 0").groupBy("sobject", "record_id").agg(F.min("amount").cast("string").alias("a")).withColumn("fields", F.create_map(F.lit("Amount"), F.col("a")))


_SNAP = "snap AS (SELECT sobject, record_id, min(amount) AS a FROM cdc WHERE event_id % 3 = 0 GROUP BY 1, 2)"


@query(f"""WITH {_SNAP}, q AS (SELECT DISTINCT sobject, record_id FROM cdc WHERE starts_with(change_type, 'GAP_')), c AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY sobject ORDER BY record_id) - 1) / 200) AS BIGINT) AS chunk FROM q)
    SELECT c.sobject, c.record_id, chunk, CASE WHEN s.record_id IS NULL THEN 'deleted' ELSE 'upserted' END AS outcome, CAST(a AS VARCHAR) AS amount FROM c LEFT JOIN snap s USING (sobject, record_id)""", "cdc")
def cdc_gap_resync(spark, rows):
    return cdc.refetch_gaps(rows, _snapshot(rows)).select("sobject", "record_id", "chunk", "outcome", F.col("fields")["Amount"].alias("amount"))


@query(f"""WITH {_SNAP}, l AS ({_LAST}), st AS (SELECT * FROM l WHERE change_type <> 'DELETE'), k AS (SELECT DISTINCT sobject, record_id FROM cdc)
    SELECT k.sobject, k.record_id, CAST(CASE WHEN st.record_id IS NOT NULL THEN st.amount ELSE snap.a END AS VARCHAR) AS amount, CASE WHEN st.record_id IS NOT NULL THEN 'state' WHEN snap.record_id IS NOT NULL THEN 'production' ELSE 'none' END AS layer
    FROM k LEFT JOIN st USING (sobject, record_id) LEFT JOIN snap USING (sobject, record_id)""", "cdc")
def cdc_layered_read(spark, rows):
    keys = rows.select("sobject", "record_id").distinct()
    return cdc.layered(keys, cdc.last_state(_events(rows)), _snapshot(rows)).select("sobject", "record_id", F.col("fields")["Amount"].alias("amount"), "layer")


@query(f"""WITH {_SNAP}, l AS ({_LAST}), st AS (SELECT * FROM l WHERE change_type <> 'DELETE'), g AS (SELECT DISTINCT sobject, record_id FROM cdc WHERE starts_with(change_type, 'GAP_'))
    SELECT sobject, record_id, CAST(amount AS VARCHAR) AS amount FROM st ANTI JOIN g USING (sobject, record_id) UNION ALL SELECT sobject, record_id, CAST(a AS VARCHAR) FROM g JOIN snap USING (sobject, record_id)""", "cdc")
def cdc_corrected_state(spark, rows):
    state = cdc.last_state(_events(rows))
    return cdc.corrected(state, cdc.refetch_gaps(rows, _snapshot(rows))).select("sobject", "record_id", F.col("fields")["Amount"].alias("amount"))


_RULED = "CASE WHEN amount > 100 THEN CAST(amount + 1 AS VARCHAR) ELSE CAST(amount AS VARCHAR) END"


def _ruled():
    amount = F.col("amount").cast("string")
    return F.create_map(F.lit("Amount"), F.when(F.col("amount") > 100, (F.col("amount") + 1).cast("string")).otherwise(amount), F.lit("Status"), F.when(F.col("status") == "click", "").otherwise(F.upper("status")))


@query(f"""WITH d AS (SELECT event_id, CAST(amount AS VARCHAR) AS a, {_RULED} AS b, status AS s, CASE WHEN status = 'click' THEN NULL ELSE upper(status) END AS u FROM cdc)
    SELECT event_id, CASE WHEN a IS DISTINCT FROM b THEN 1 ELSE 0 END + CASE WHEN s IS DISTINCT FROM u THEN 1 ELSE 0 END AS n, concat_ws(',', CASE WHEN a IS DISTINCT FROM b THEN 'Amount' END, CASE WHEN s IS DISTINCT FROM u THEN 'Status' END) AS fields FROM d""", "cdc")
def field_diff_map(spark, rows):
    diffs = _events(rows).withColumn("d", S.field_diff(F.col("fields"), _ruled()))
    return diffs.select("event_id", F.size("d").alias("n"), joined(F.array_sort(F.map_keys("d"))).alias("fields"))


@query(f"""WITH l AS ({_LAST}), d AS (SELECT sobject, record_id, unnest([{{'f': 'Amount', 'p': CAST(amount AS VARCHAR), 'r': {_RULED}}}, {{'f': 'Status', 'p': status, 'r': CASE WHEN status = 'click' THEN NULL ELSE upper(status) END}}]) AS x FROM l)
    SELECT sobject, record_id, x.f AS field, x.p AS production, CASE WHEN x.f = 'Status' AND x.r IS NULL THEN '' ELSE x.r END AS runtime FROM d WHERE x.p IS DISTINCT FROM x.r""", "cdc")
def field_diff_long(spark, rows):
    last = cdc.last_state(_events(rows), keep_deleted=True)
    runtime = last.withColumns({"amount": F.col("fields")["Amount"].cast("int"), "status": F.col("fields")["Status"]}).withColumn("fields", _ruled())
    return cdc.diff_long(last, runtime)


@query("""SELECT event_id, amount IS NOT NULL AS plain, true AS signed, false AS word, CASE WHEN amount IS NULL THEN false ELSE true END AS decimal FROM cdc""", "cdc")
def numeric_only_diffs(spark, rows):
    a = F.col("amount").cast("string")
    return rows.select("event_id", S.looks_numeric(a).alias("plain"), S.looks_numeric(F.concat(F.lit("--"), F.col("event_id").cast("string"))).alias("signed"), S.looks_numeric(F.col("status")).alias("word"), S.looks_numeric(F.concat(a, F.lit(".5"))).alias("decimal"))


_OBSERVED = f"""o AS (SELECT event_id, CASE WHEN starts_with(change_type, 'GAP_') THEN 'gap_event_full_refetch_required' WHEN status = 'view' THEN 'translation_error' WHEN amount > 100 THEN 'formula_edge_case' END AS category FROM cdc)"""


def _observed(rows):
    amount = F.when(F.col("amount") > 100, (F.col("amount") + 1).cast("string")).otherwise(F.col("amount").cast("string"))
    after = F.create_map(F.lit("Amount"), amount, F.lit("Status"), F.col("status"))
    view_event = F.col("status") == "view"
    return cdc.observe(_events(rows), after, view_event, F.when(view_event, "validation failed: x"))


@query(f"WITH {_OBSERVED} SELECT event_id, category, category IS NOT NULL AS diverged, CAST(CASE category WHEN 'gap_event_full_refetch_required' THEN 80 WHEN 'translation_error' THEN 50 WHEN 'formula_edge_case' THEN 40 ELSE 0 END AS INT) AS severity FROM o", "cdc")
def divergence_categorise(spark, rows):
    return _observed(rows).select("event_id", "category", "diverged", "severity")


@query(f"WITH {_OBSERVED} SELECT coalesce(category, 'clean') AS category, count(*) AS n FROM o GROUP BY 1", "cdc")
def divergence_by_category(spark, rows):
    return _observed(rows).groupBy(F.coalesce("category", F.lit("clean")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def _stream_events(rows):
    return _events(rows).select("replay_id", "sobject", "record_id", "change_type", F.col("commit_ts").cast("timestamp").alias("commit_ts"), "fields")


def shadow_rules():
    """Made where they are used, so that they travel to the workers by value."""
    return [lambda r: {"Score": "1"} if r.get("Status") == "purchase" else None, lambda r: None if r.get("Amount") else "no amount"]


@query(None, "cdc")
def shadow_state_batch(spark, rows):
    return shadow.shadow_batch(_stream_events(rows), shadow_rules())


@query(None, "cdc")
def stream_shadow_state(spark, rows):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    where = shared_path(spark, "shadow")
    _stream_events(rows).write.json(f"{where}/in")
    shadow.run_once(shadow.shadow_stream(changes.read_stream(spark, f"{where}/in"), shadow_rules()), f"{where}/out", f"{where}/checkpoint")
    return spark.read.parquet(f"{where}/out")


@query(_ready(), "obs")
def stream_readiness(spark, obs):
    where = shared_path(spark, "readiness")
    obs.select("process_id", "observed_at", "diverged", "severity").write.parquet(f"{where}/in")
    schema = spark.read.parquet(f"{where}/in").schema
    scored = readiness.readiness(spark.readStream.schema(schema).parquet(f"{where}/in"))

    def write(batch, _):
        batch.write.mode("overwrite").parquet(f"{where}/out")  # each micro-batch has all processes' totals

    scored.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/out")


@query(f"""WITH {_OBSERVED}, f AS (SELECT category, min(event_id) AS id FROM o WHERE category IN ('formula_edge_case', 'translation_error') GROUP BY 1)
    SELECT 'divergence-' || category AS finding_id, 'discovered_undocumented' AS category, CASE WHEN category = 'translation_error' THEN 'major' ELSE 'minor' END AS severity, 'Observed during shadow execution; categorized as ' || category || '.' AS rationale,
    CASE WHEN amount > 100 THEN 'Runtime produced: Amount=' || (amount + 1) ELSE 'Runtime produced: ' END AS runtime_behavior FROM f JOIN cdc ON id = event_id""", "cdc")
def parity_findings(spark, rows):
    seen = _observed(rows).filter("category in ('formula_edge_case', 'translation_error')").withColumn("id", F.col("event_id"))
    return readiness.parity_findings(seen).select("finding_id", "category", "severity", "rationale", "runtime_behavior")


_AUDIT = "(SELECT n_nationkey AS step, 'step ' || n_nationkey AS step_name, n_nationkey % 2 = 0 AS in_scope FROM nation)"


@query(f"""SELECT 'excluded-step-' || step AS finding_id, 'deliberate_simplification' AS category, 'OoE step ' || step || ' (' || step_name || ') executes for matching transactions' AS production_behavior,
    'Runtime explicitly refuses transactions exercising this step (StepNotInScopeError)' AS runtime_behavior, 'info' AS severity, 'open' AS customer_disposition FROM {_AUDIT} WHERE NOT in_scope
    UNION ALL SELECT 'limit-' || r_name, 'platform_imposed_deviation', 'Production enforces governor limit: ' || r_name, 'Runtime does not enforce this limit; transactions that would exceed it in production execute to completion externally', 'minor', 'open' FROM region""", "nation", "region")
def parity_expected(spark, nation, region):
    audit = nation.selectExpr("n_nationkey AS step", "concat('step ', n_nationkey) AS step_name", "n_nationkey % 2 = 0 AS in_scope")
    both = readiness.excluded_step_findings(audit).unionByName(readiness.limit_findings(region.select(F.col("r_name").alias("limit"))))
    return both.drop("rationale")


# --- formulas ---------------------------------------------------------------------------------------------------


def _formulas(df, *keep, **formulas):
    made = L.evaluate(df, **formulas)
    return made.select(*keep, *formulas, *(f"{n}_error" for n in formulas))


@query("SELECT id, Price * (1 - Discount) AS net, false AS net_error, Quantity + 1 AS plus, false AS plus_error, CASE WHEN Discount <> 0 THEN Price / Discount END AS ratio, Discount = 0 AS ratio_error, -Tax AS negative, false AS negative_error FROM rec_line", "rec_line")
def formula_arith(spark, rec):
    return _formulas(rec, "id", net="Price * (1 - Discount)", plus="Quantity + 1", ratio="Price / Discount", negative="-Tax")


@query("""SELECT event_id, amount IS NULL AS blank, false AS blank_error, CASE WHEN amount IS NOT NULL THEN amount > 100 END AS over, amount IS NULL AS over_error, amount IS NOT DISTINCT FROM 150 AS same, false AS same_error,
    amount IS DISTINCT FROM 150 AS differs, false AS differs_error, false AS cross_type, false AS cross_type_error FROM cdc""", "cdc")
def formula_compare_null(spark, rows):
    return _formulas(rows.select("event_id", "amount", "status"), "event_id", blank="amount = NULL", over="amount > 100", same="amount = 150", differs="amount <> 150", cross_type='amount = "150"')


@query("""SELECT event_id, coalesce(amount > 100, false) AND status = 'click' AS a, amount IS NULL AS a_error, coalesce(amount, 0) <> 0 OR status = 'view' AS b, false AS b_error, coalesce(amount, 0) = 0 AS c, false AS c_error FROM cdc""", "cdc")
def formula_logic(spark, rows):
    made = L.evaluate(rows.select("event_id", "amount", "status"), a='AND(amount > 100, status = "click")', b='!!(amount || (status = "view"))', c="!amount")
    # a failing formula has no value; here it counts as false
    return made.select("event_id", F.coalesce("a", F.lit(False)).alias("a"), "a_error", F.col("b"), "b_error", "c", "c_error")


@query("""SELECT id, CASE WHEN Amount > 100000 THEN 'big' ELSE 'small' END AS size, false AS size_error, CASE Stage WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END::BIGINT AS code, false AS code_error,
    CASE WHEN Stage = 'F' THEN Amount / 2 ELSE Amount END AS lazy, false AS lazy_error FROM rec_opp""", "rec_opp")
def formula_if_case(spark, rec):
    return _formulas(rec, "id", size='IF(Amount > 100000, "big", "small")', code='CASE(Stage, "F", 1, "O", 2, 0)', lazy='IF(Stage = "F", Amount / 2, IF(TRUE, Amount, 1 / 0))')


@query("""SELECT event_id, amount IS NULL AS blank, false AS blank_error, coalesce(amount, -1)::BIGINT AS filled, false AS filled_error, false AS word, false AS word_error FROM cdc""", "cdc")
def formula_blank(spark, rows):
    return _formulas(rows.select("event_id", "amount", "status"), "event_id", blank="ISBLANK(amount)", filled="BLANKVALUE(amount, -1)", word="ISNULL(status)")


@query("""SELECT id, upper(Segment) AS u, false AS u_error, left(Name, 4) AS l, false AS l_error, left(Name, length(Name) - 3) AS cut, false AS cut_error, right(Name, 3) AS r, false AS r_error, length(Name) AS n, false AS n_error,
    replace(Priority, '-', '/') AS s, false AS s_error, Stage || '-' || Priority AS j, false AS j_error, CAST(id AS VARCHAR) AS t, false AS t_error FROM rec_opp""", "rec_opp")
def formula_text(spark, rec):
    return _formulas(rec, "id", u="UPPER(Segment)", l="LEFT(Name, 4)", cut="LEFT(Name, -3)", r="RIGHT(Name, 3)", n="LEN(Name)", s='SUBSTITUTE(Priority, "-", "/")', j='Stage + "-" + Priority', t="TEXT(id)")


@query("""SELECT id, instr(Priority, '-')::BIGINT AS f, false AS f_error, substr(Name, 3, 5) AS m, false AS m_error, starts_with(Segment, 'BUILD') AS b, false AS b_error, contains(Name, '99') AS c, false AS c_error FROM rec_opp""", "rec_opp")
def formula_find_mid(spark, rec):
    return _formulas(rec, "id", f='FIND("-", Priority)', m="MID(Name, 3, 5)", b='BEGINS(Segment, "BUILD")', c='CONTAINS(Name, "99")')


@query("""SELECT id, Balance - 7 * floor(Balance / 7) AS m, false AS m_error, CAST(floor(Amount) AS BIGINT) AS fl, false AS fl_error, CAST(ceil(Amount) AS BIGINT) AS ce, false AS ce_error, abs(Balance) AS a, false AS a_error,
    greatest(Balance, 0.0) AS hi, false AS hi_error, least(Balance, Amount) AS lo, false AS lo_error, CAST(round_even(Amount, 0) AS BIGINT) AS ro, false AS ro_error FROM rec_opp""", "rec_opp")
def formula_math_mod_round(spark, rec):
    return _formulas(rec, "id", m="MOD(Balance, 7)", fl="FLOOR(Amount)", ce="CEILING(Amount)", a="ABS(Balance)", hi="MAX(Balance, 0)", lo="MIN(Balance, Amount)", ro="ROUND(Amount)")


@query("""SELECT event_id, CASE WHEN event_id % 13 BETWEEN 1 AND 12 AND event_id % 29 >= 1 THEN CAST(make_date(2023, CAST(event_id % 13 AS INT), CAST(least(event_id % 29, 28) AS INT)) AS VARCHAR) END AS d, event_id % 13 = 0 OR event_id % 29 = 0 AS d_error, CAST(CAST(DATE '2024-01-31' + to_months(CAST(event_id % 24 AS INT)) AS DATE) AS VARCHAR) AS a, false AS a_error FROM cdc""", "cdc")
def formula_dates(spark, rows):
    made = L.evaluate(rows.select((F.col("event_id") % 13).alias("m"), (F.col("event_id") % 29).alias("day"), (F.col("event_id") % 24).alias("k"), "event_id"), d="DATE(2023, m, day)", a="ADDMONTHS(DATE(2024, 1, 31), k)")
    return made.select("event_id", F.col("d").cast("string").alias("d"), "d_error", F.col("a").cast("string").alias("a"), "a_error")


@query("SELECT id, Name AS n, false AS n_error, CAST(NULL AS VARCHAR) AS missing, false AS missing_error, Balance > 0 AS rich, false AS rich_error FROM rec_opp", "rec_opp")
def formula_dotted(spark, rec):
    nested = rec.select("id", F.struct(F.col("Name"), F.struct(F.col("Balance").alias("Value")).alias("Money")).alias("Account"))
    return _formulas(nested, "id", n="Account.Name", missing="Account.Owner.Email", rich="Account.Money.Value > 0")


@query("SELECT event_id, CASE WHEN amount IS NOT NULL THEN CAST(amount AS DOUBLE) ELSE 0.0::DOUBLE END AS v, false AS v_error, CAST(NULL AS DOUBLE) AS w, true AS w_error FROM cdc", "cdc")
def formula_value(spark, rows):
    return _formulas(rows.select("event_id", F.col("amount").cast("string").alias("a"), "status"), "event_id", v="VALUE(a)", w="VALUE(status)")


@query("""SELECT event_id, coalesce(amount > 100, false) OR status = 'click' AS o, amount IS NULL AS o_error, coalesce(amount, 0) = 0 AS n, false AS n_error, status = 'view' AS p, false AS p_error, coalesce(amount, 7)::BIGINT AS v, false AS v_error,
    lower(upper(status)) AS l, false AS l_error, status AS t, false AS t_error FROM cdc""", "cdc")
def formula_functions(spark, rows):
    """A failing formula has no value; the first one counts as its second operand here."""
    made = L.evaluate(rows.select("event_id", "amount", "status"), o='OR(amount > 100, status = "click")', n="NOT(amount)", p='ISPICKVAL(status, "view")', v="NULLVALUE(amount, 7)", l="LOWER(UPPER(status))", t='TRIM("  " + status + " ")')
    return made.withColumn("o", F.coalesce("o", F.col("status") == "click")).select("event_id", *(f"{c}{e}" for c in "onpvlt" for e in ("", "_error")))


@query("SELECT event_id, '2024-01-31' AS today, CAST(0 AS BIGINT) AS late FROM cdc", "cdc")
def formula_today_now(spark, rows):
    """Both functions at a given moment."""
    at = lambda text: L.compile_formula(text, rows.schema, as_of=NOW).value
    return rows.select("event_id", at("TODAY()").cast("string").alias("today"), (F.unix_timestamp(at("NOW()")) - F.unix_timestamp(F.lit(NOW).cast("timestamp"))).alias("late"))


# --- rules ------------------------------------------------------------------------------------------------------

_OPP_RULES = [
    rules.validation("v_amount", "Opp", "Amount < 20000", "amount too small"),
    rules.validation("v_stage", "Opp", 'Stage = "P"', "still pending"),
    rules.formula_field("f_net", "Opp", "Net", "Amount * 0.9"),
]
_WORKFLOW = rules.workflow(
    "Opp",
    [{"active": True, "criteria": [("Opp.Amount", "greaterThan", "150000")], "actions": ["hot", "gone"]}, {"active": True, "criteria": [("Segment", "startsWith", "BUILD"), ("Balance", "greaterThan", "0")], "actions": ["build"]}, {"active": False, "criteria": [], "actions": ["never"]}],
    {"hot": {"field": "Status", "literal": "hot"}, "build": {"field": "Status", "literal": "build"}, "never": {"field": "Status", "literal": "never"}},
)
_ASSIGN = rules.assignment("a_owner", "Opp", [{"active": True, "entries": [{"criteria": [("Priority", "contains", "URGENT")], "owner": "q1"}, {"criteria": [("Balance", "lessThan", "0")], "owner": "q2"}, {"criteria": [("Stage", "notEqual", "F")], "owner": "q3"}]}])


@query("SELECT id, Amount < 20000 AS amount_failed, Stage = 'P' AS stage_failed FROM rec_opp", "rec_opp")
def rule_validation_results(spark, rec):
    done = rules.run(rec, _OPP_RULES[:2])
    failed = lambda k: F.exists("_results", lambda x: (x["rule_id"] == k) & ~x["passed"])
    return done.select("id", failed("v_amount").alias("amount_failed"), failed("v_stage").alias("stage_failed"))


@query("SELECT id, Amount < 20000 OR Stage = 'P' AS aborted, CASE WHEN Amount < 20000 OR Stage = 'P' THEN 'validation failed: ' || concat_ws('; ', CASE WHEN Amount < 20000 THEN 'amount too small' END, CASE WHEN Stage = 'P' THEN 'still pending' END) END AS reason FROM rec_opp", "rec_opp")
def rule_abort_reason(spark, rec):
    return rules.run(rec, _OPP_RULES[:2]).select("id", F.col("_aborted").alias("aborted"), F.col("_abort_reason").alias("reason"))


@query("SELECT id, Amount * 0.9::DOUBLE AS net FROM rec_opp", "rec_opp")
def rule_formula_field(spark, rec):
    return rules.run(rec, _OPP_RULES[2:]).select("id", F.col("Net").alias("net"))


_STATUS = "CASE WHEN starts_with(Segment, 'BUILD') AND Balance > 0 THEN 'build' WHEN Amount > 150000 THEN 'hot' END"


@query(f"SELECT id, {_STATUS} AS status, {_STATUS} IS NOT NULL AS refired FROM rec_opp", "rec_opp")
def rule_workflow_updates(spark, rec):
    return rules.run(rec, [_WORKFLOW]).select("id", F.col("Status").alias("status"), F.col("_refired").alias("refired"))


_OWNER = "CASE WHEN contains(Priority, 'URGENT') THEN 'q1' WHEN Balance < 0 THEN 'q2' WHEN Stage <> 'F' THEN 'q3' END"


@query(f"SELECT id, {_OWNER} AS owner FROM rec_opp", "rec_opp")
def rule_assignment_first_match(spark, rec):
    return rules.run(rec, [_ASSIGN]).select("id", F.col("OwnerId").alias("owner"))


@query("SELECT id, true AS seen, 'F' AS stage FROM rec_opp", "rec_opp")
def rule_before_save_flow(spark, rec):
    return rules.run(rec, [rules.flow("f", "Opp", {"Seen": True, "Stage": "F"}, "RecordBeforeSave")]).select("id", F.col("Seen").alias("seen"), F.col("Stage").alias("stage"))


@query(f"""WITH r AS (SELECT id, Amount < 20000 OR Stage = 'P' AS aborted, Amount * 0.9::DOUBLE AS net, {_OWNER} AS o, {_STATUS} AS s FROM rec_opp)
    SELECT id, aborted, net, CASE WHEN NOT aborted THEN o END AS owner, CASE WHEN NOT aborted THEN s END AS status, NOT aborted AND s IS NOT NULL AS refired,
    CAST(4 + CASE WHEN aborted THEN 0 ELSE 2 END + CASE WHEN NOT aborted AND s IS NOT NULL THEN 1 ELSE 0 END AS INT) AS n_results FROM r""", "rec_opp")
def rule_refire_pipeline(spark, rec):
    before = rules.flow("b_flow", "Opp", {"Touched": 1}, "RecordBeforeSave")
    done = rules.run(rec, [*_OPP_RULES, _WORKFLOW, _ASSIGN, before])
    return done.select("id", F.col("_aborted").alias("aborted"), F.col("Net").alias("net"), F.col("OwnerId").alias("owner"), F.col("Status").alias("status"), F.col("_refired").alias("refired"), F.size("_results").alias("n_results"))


@query("""SELECT id, concat_ws('|', 'txn=' || id, 'sobject=Opp', 'refire=' || CASE WHEN refired THEN 'True' ELSE 'False' END, 'refire_done=' || CASE WHEN refired THEN 'True' ELSE 'False' END, 'cascade_depth=0', 'rule_results=' || CASE WHEN aborted THEN 3 ELSE 4 END, 'cascaded_dml=0',
    'aborted=' || CASE WHEN aborted THEN 'True(validation failed: ' || concat_ws('; ', CASE WHEN Amount < 20000 THEN 'amount too small' END, CASE WHEN Stage = 'P' THEN 'still pending' END) || ')' ELSE 'False(None)' END) AS trace
    FROM (SELECT *, Amount < 20000 OR Stage = 'P' AS aborted, NOT (Amount < 20000 OR Stage = 'P') AND (Amount > 150000 OR (starts_with(Segment, 'BUILD') AND Balance > 0)) AS refired FROM rec_opp)""", "rec_opp")
def rule_trace(spark, rec):
    done = rules.run(rec, [*_OPP_RULES, _WORKFLOW])
    return done.select("id", F.array_join(rules.trace(F.col("id"), F.lit("Opp")), "|").alias("trace"))


@query("""SELECT txn, seq, sobject, record_id, row_number() OVER (PARTITION BY txn, sobject, coalesce(nullif(record_id, ''), CAST(txn AS VARCHAR)) ORDER BY seq) = 1 AS fires FROM saves""", "saves")
def rule_once_per_entity(spark, saves):
    return rules.once_per_entity(saves)


@query("SELECT txn, seq, CAST(row_number() OVER (PARTITION BY txn ORDER BY seq) - 1 AS INT) AS depth, row_number() OVER (PARTITION BY txn ORDER BY seq) - 1 > 16 AS exceeded FROM saves", "saves")
def rule_cascade_limit(spark, saves):
    return rules.cascade(saves).select("txn", "seq", "depth", "exceeded")


@query("""WITH b AS (SELECT txn, seq, bool_or(lower(sobject) IN ('user', 'permissionset')) OVER w AND bool_or(lower(sobject) NOT IN ('user', 'permissionset')) OVER w AS b FROM saves WINDOW w AS (PARTITION BY txn ORDER BY seq))
    SELECT txn, seq, b AND NOT coalesce(lag(b) OVER (PARTITION BY txn ORDER BY seq), false) AS conflict FROM b""", "saves")
def rule_mixed_objects(spark, saves):
    return rules.mixed_objects(saves).select("txn", "seq", "conflict")


@query("SELECT e.id, r.rule_id, r.kind FROM (SELECT id, CASE WHEN Stage = 'F' THEN 6 ELSE 12 END AS step FROM rec_opp) e JOIN (VALUES ('v_amount', 'validation', 6), ('v_stage', 'validation', 6), ('f_net', 'computation', 6), ('Opp.workflow', 'computation', 12)) r(rule_id, kind, step) USING (step)", "rec_opp")
def rule_step_lookup(spark, rec):
    events = rec.select("id", F.lit("Opp").alias("sobject"), F.when(F.col("Stage") == "F", 6).otherwise(12).alias("step"))
    return rules.rules_for(events, rules.catalog(spark, [*_OPP_RULES, _WORKFLOW])).select("id", "rule_id", "kind")


@query("""WITH r AS (SELECT unnest(['a', 'b', 'c']) AS rule_id), t AS (SELECT DISTINCT txn FROM saves)
    SELECT txn, rule_id, CAST(row_number() OVER (PARTITION BY txn ORDER BY md5('42:' || txn || ':' || rule_id), rule_id) AS INT) AS place FROM t, r""", "saves")
def rule_seeded_order(spark, saves):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "rule_id string")
    return rules.rule_order(ids, 42, saves.select("txn").distinct()).select("txn", "rule_id", "place")


_CRIT = [("Stage", "equals", "F"), ("Amount", "greaterOrEqual", "50000"), ("Name", "contains", "1")]


@query("SELECT id, Stage = 'F' AND Amount >= 50000 AND contains(Name, '1') AS hit FROM rec_opp", "rec_opp")
def criteria_conjunction(spark, rec):
    hit = rules.conjunction(rules.Record(rec.schema), _CRIT)
    return rec.select("id", L.truthy(hit).alias("hit"))


@query("SELECT id, contains(Name, '#0') AND contains(Stage, 'O') AS hit FROM rec_opp", "rec_opp")
def criteria_includes(spark, rec):
    """A multi-valued field includes a value where its text contains it, as for ``contains``."""
    hit = rules.conjunction(rules.Record(rec.schema), [("Name", "includes", "#0"), ("Stage", "includes", "O")])
    return rec.select("id", L.truthy(hit).alias("hit"))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(coalesce(text, '')), 'urgent') THEN 'high_priority' ELSE 'standard_queue' END AS route FROM conversations", "conversations")
def urgent_route(spark, conversations):
    return conversations.select("conv_id", "turn", rules.urgent_route(F.col("text")).alias("route"))


# --- corpus -----------------------------------------------------------------------------------------------------

_RANK = "CASE source WHEN 'salto' THEN 0 WHEN 'sf_cli' THEN 1 WHEN 'tooling_api' THEN 2 ELSE 99 END"


def _records(raw):
    return raw.groupBy("source", "category", "api_name", "namespace").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("payload"))


@query(f"""WITH v AS (SELECT category, api_name, namespace, field, arg_min(value, {_RANK}) AS value FROM raw_meta GROUP BY ALL), s AS (SELECT category, api_name, namespace, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM raw_meta GROUP BY ALL)
    SELECT s.category, s.api_name, s.namespace, string_agg(field || '=' || value, ',' ORDER BY field) AS payload, s.sources FROM s JOIN v ON s.api_name = v.api_name AND s.category = v.category AND s.namespace IS NOT DISTINCT FROM v.namespace GROUP BY ALL""", "raw_meta")
def reconcile_precedence(spark, raw):
    done = corpus.reconcile(_records(raw))
    entries = F.transform(F.array_sort(F.map_entries("payload")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return done.select("category", "api_name", "namespace", joined(entries).alias("payload"), joined("sources").alias("sources"))


@query(f"""WITH w AS (SELECT *, first_value(value) OVER (PARTITION BY category, api_name, namespace, field ORDER BY {_RANK}) AS winner, string_agg(source || '=' || value, ',' ) OVER (PARTITION BY category, api_name, namespace, field ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS values_by_source FROM raw_meta)
    SELECT category, api_name, namespace, field, source, value, winner, values_by_source FROM w WHERE value IS DISTINCT FROM winner""", "raw_meta")
def reconcile_disagreements(spark, raw):
    entries = F.transform(F.array_sort(F.map_entries("values_by_source")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return corpus.disagreements(_records(raw)).withColumn("values_by_source", joined(entries))


_DIM = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {d}, {r}, '{t}', {steps or '[]::INT[]'})" for c, d, r, t, steps in M.CATEGORIES) + ") x(category, difficulty, risk, tier, steps))"
_ATTEMPT = "att AS (SELECT category, decisions % 5 <> 0 AS ok, 'bad ' || decisions % 3 AS reason FROM comp WHERE decisions <> 7 AND component_id % 21 < 18)"


def _attempts(comp):
    return comp.filter("decisions <> 7 and component_id % 21 < 18").select("category", (F.col("decisions") % 5 != 0).alias("ok"), F.concat(F.lit("bad "), (F.col("decisions") % 3).cast("string")).alias("reason"))


_COVER = f"""WITH {_DIM}, {_ATTEMPT}, g AS (SELECT category, count(*) AS a, count(*) FILTER (ok) AS s, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason) FILTER (NOT ok), '') AS reasons FROM att GROUP BY 1),
    rep AS (SELECT dim.category, coalesce(a, 0) AS attempted, coalesce(s, 0) AS succeeded, coalesce(a - s, 0) AS failed, coalesce(reasons, '') AS reasons, CASE WHEN a IS NULL THEN 1.0::DOUBLE ELSE s / CAST(a AS DOUBLE) END AS ratio FROM dim LEFT JOIN g USING (category))"""


@query(_COVER + " SELECT * FROM rep", "comp")
def coverage_report(spark, comp):
    return corpus.coverage(_attempts(comp)).withColumn("reasons", joined("reasons"))


@query(_COVER + " SELECT category, attempted, ratio FROM rep WHERE attempted > 0 ORDER BY category", "comp")
def coverage_rows(spark, comp):
    return corpus.coverage(_attempts(comp)).filter("attempted > 0").select("category", "attempted", "ratio").orderBy("category")


@query(_COVER + " SELECT CAST(sum(attempted) AS BIGINT) AS attempted, CAST(sum(succeeded) AS BIGINT) AS succeeded, CAST(sum(failed) AS BIGINT) AS failed, sum(succeeded) / CAST(sum(attempted) AS DOUBLE) AS ratio FROM rep", "comp")
def coverage_overall(spark, comp):
    return corpus.overall_coverage(corpus.coverage(_attempts(comp)))


@query(f"WITH {_DIM}, {_ATTEMPT} SELECT category FROM dim ANTI JOIN att USING (category)", "comp")
def coverage_gaps(spark, comp):
    return corpus.suspected_gaps(_attempts(comp), include_unseen=True)


@query(f"""WITH {_DIM}, used AS (SELECT category, count(*) AS n FROM comp GROUP BY 1), st AS (SELECT category, unnest(steps) AS step FROM dim), g AS (SELECT step, CAST(sum(n) AS BIGINT) AS n, string_agg(category, ',' ORDER BY category) AS c FROM st JOIN used USING (category) GROUP BY 1),
    f AS (SELECT s AS step, s % 8 AS observed FROM range(1, 22) r(s) WHERE s % 3 <> 0) SELECT CAST(r.s AS INT) AS step, coalesce(n, 0) AS structural_count, coalesce(c, '') AS contributing, NOT (coalesce(n, 0) = 0 OR coalesce(observed = 0, false)) AS in_scope,
    CASE WHEN coalesce(n, 0) = 0 OR coalesce(observed = 0, false) THEN 'exclude' WHEN observed < 5 THEN 'standard' WHEN n >= 10 THEN 'critical' ELSE 'standard' END AS priority FROM range(1, 22) r(s) LEFT JOIN g ON g.step = r.s LEFT JOIN f ON f.step = r.s""", "comp")
def surface_audit(spark, comp):
    seen = spark.range(1, 22).filter("id % 3 <> 0").select(F.col("id").cast("int").alias("step"), (F.col("id") % 8).alias("observed"))
    return corpus.surface_audit(comp, seen).select("step", "structural_count", joined("contributing").alias("contributing"), "in_scope", "priority")


@query("""SELECT 'kevin_ohara' AS framework, 0.85::DOUBLE AS confidence, CAST((SELECT count(*) FROM part WHERE p_partkey % 9 = 0) + 1 AS BIGINT) AS hits UNION ALL SELECT 'trigger_actions', 0.95::DOUBLE, (SELECT count(*) FROM nation WHERE n_nationkey < 3)""", "part", "nation")
def framework_signals(spark, part, nation):
    names = part.filter("p_partkey % 9 = 0").select(F.concat(F.lit("N"), F.col("p_partkey").cast("string"), F.lit("TriggerHandler")).alias("name")).union(spark.createDataFrame([("TriggerHandler",), ("fflib_A",)], "name string"))
    types = nation.select(F.when(F.col("n_nationkey") < 3, "Trigger_Action__mdt").otherwise("Other__mdt").alias("cmt_type"))
    return corpus.framework_signals(names, types)


@query("""WITH g AS (SELECT lower(namespace) AS namespace, count(*) AS members FROM comp WHERE namespace <> '' GROUP BY 1)
    SELECT namespace, CASE WHEN namespace IN ('sbqq', 'apxt', 'dsfs', 'et4ae5', 'pi') THEN 'hand_tuned' ELSE 'auto' END AS kind, CASE namespace WHEN 'sbqq' THEN 'cpq' WHEN 'pi' THEN 'pardot' ELSE namespace END AS adapter, members FROM g""", "comp")
def package_groups(spark, comp):
    return corpus.packages(comp)


@query("""WITH cls AS (SELECT 'Cls_' || p_partkey AS name FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'Handler' || s_suppkey FROM supplier), rec AS (SELECT 'd' || o_orderkey AS dispatcher, unnest(['h', 'g']) AS field, unnest([CASE o_orderkey % 4 WHEN 0 THEN 'Handler' || o_custkey % 20 WHEN 1 THEN 'HANDLER' || o_custkey % 20 WHEN 2 THEN 'cls_zzz' ELSE '' END, 'Cls_' || o_custkey % 50]) AS value FROM orders)
    SELECT dispatcher, field, coalesce(e.name, l.name, h.name) AS handler, CASE WHEN e.name IS NOT NULL THEN 1.0::DOUBLE WHEN l.name IS NOT NULL THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM rec LEFT JOIN cls e ON value = e.name LEFT JOIN (SELECT lower(name) AS k, max(name) AS name FROM cls GROUP BY 1) l ON lower(value) = l.k
    LEFT JOIN (SELECT split_part(lower(name), '_', 1) AS k, max(name) AS name FROM cls GROUP BY 1) h ON split_part(lower(value), '_', 1) = h.k WHERE value <> '' AND coalesce(e.name, l.name, h.name) IS NOT NULL""", "part", "supplier", "orders")
def dispatch_best_match(spark, part, supplier, orders):
    names = part.filter("p_partkey % 2 = 0").selectExpr("concat('Cls_', p_partkey) AS name").union(supplier.selectExpr("concat('Handler', s_suppkey) AS name"))
    fields = F.expr("map('h', CASE o_orderkey % 4 WHEN 0 THEN concat('Handler', o_custkey % 20) WHEN 1 THEN concat('HANDLER', o_custkey % 20) WHEN 2 THEN 'cls_zzz' ELSE '' END, 'g', concat('Cls_', o_custkey % 50))")
    return corpus.dispatch_edges(orders.select(F.expr("concat('d', o_orderkey)").alias("developer_name"), fields.alias("fields")), names)


@query("""WITH b AS (SELECT string_agg('call Cls' || l_partkey * 2 || '.run()', ' ') AS body FROM lineitem GROUP BY l_orderkey) SELECT api_name AS name FROM comp WHERE category = 'apex_class' AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT unnest(regexp_split_to_array(body, '[^A-Za-z0-9_]+')) AS w FROM b) x WHERE x.w = api_name)""", "comp", "lineitem")
def orphan_anti_join(spark, comp, lineitem):
    bodies = lineitem.groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.expr("concat('call Cls', l_partkey * 2, '.run()')")), " ").alias("body"))
    return corpus.orphans(comp.filter("category = 'apex_class'").select(F.col("api_name").alias("name")), bodies)


@query("""WITH b AS (SELECT 'x Cls' || n_nationkey * 3 || 'y' AS body FROM nation) SELECT api_name AS name FROM comp WHERE category = 'apex_class' AND NOT EXISTS (SELECT 1 FROM b WHERE contains(body, api_name))""", "comp", "nation")
def orphan_contained(spark, comp, nation):
    bodies = nation.select(F.expr("concat('x Cls', n_nationkey * 3, 'y')").alias("body"))
    return corpus.orphans_contained(comp.filter("category = 'apex_class'").select(F.col("api_name").alias("name")), bodies)


_CH = "ch AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {k}, {conf}::DOUBLE)" for k, (c, conf) in enumerate(corpus.CHANNELS)) + ") x(channel, k, confidence))"


@query(f"""WITH {_CH}, si AS (SELECT 'Cls' || o_custkey AS name, ['runtime_log', 'lwc_import', 'named_credential', 'connected_app_scope', 'cron_trigger', 'integration_doc'][CAST(1 + (o_orderkey * 7 + o_custkey) % 6 AS INT)] AS channel, 'e' || o_orderkey % 3 AS evidence FROM orders WHERE o_custkey % 3 <> 0),
    g AS (SELECT name, channel, string_agg(DISTINCT evidence, ', ' ORDER BY evidence) AS evidence FROM si GROUP BY 1, 2), b AS (SELECT name, arg_min(channel, k) AS channel, arg_min(evidence, k) AS evidence, arg_min(confidence, k) AS confidence FROM g JOIN ch USING (channel) GROUP BY 1)
    SELECT api_name AS name, channel, evidence, confidence FROM comp LEFT JOIN b ON b.name = api_name""", "comp", "orders")
def orphan_channel_cascade(spark, comp, orders):
    names = F.array(*(F.lit(c) for c, _ in corpus.CHANNELS))
    seen = orders.filter("o_custkey % 3 <> 0").select(F.expr("concat('Cls', o_custkey)").alias("name"), F.element_at(names, F.expr("CAST(1 + (o_orderkey * 7 + o_custkey) % 6 AS INT)")).alias("channel"), F.expr("concat('e', o_orderkey % 3)").alias("evidence"))
    return corpus.resolve_orphans(comp.select(F.col("api_name").alias("name")), seen)


_MODS = """CASE WHEN flow AND decisions >= 20 THEN 20 WHEN flow AND decisions >= 8 THEN 8 ELSE 0 END + CASE WHEN flow AND dml >= 5 THEN 10 ELSE 0 END + CASE WHEN flow THEN least(subflows, 4) * 5 ELSE 0 END
    + CASE WHEN category = 'apex_trigger' AND body_lines >= 200 THEN 20 ELSE 0 END + CASE WHEN category = 'apex_trigger' AND n_events >= 3 THEN 10 ELSE 0 END + CASE WHEN category = 'lwc_bundle' THEN CASE classification WHEN 'business_logic_heavy' THEN 25 WHEN 'mixed' THEN 10 ELSE 0 END ELSE 0 END
    + CASE WHEN category = 'lwc_bundle' AND n_imports >= 3 THEN 5 ELSE 0 END + CASE WHEN category = 'validation_rule' AND length(formula) > 200 THEN 15 ELSE 0 END + CASE WHEN category = 'formula_field' AND regexp_matches(formula, '^[^.]*[A-Z][^.]*\\.') THEN 10 ELSE 0 END + CASE WHEN category = 'formula_field' AND length(formula) > 300 THEN 15 ELSE 0 END"""
_RISK = "CASE WHEN flow AND dml >= 5 THEN 10 ELSE 0 END + CASE WHEN category = 'screen_flow' AND screens > 0 THEN -5 ELSE 0 END + CASE WHEN category = 'validation_rule' AND length(formula) > 200 THEN 10 ELSE 0 END"
_DRIVERS = """concat_ws(';', 'baseline for ' || category, CASE WHEN flow AND decisions >= 20 THEN decisions || ' decision nodes (>=20)' WHEN flow AND decisions >= 8 THEN decisions || ' decision nodes' END, CASE WHEN flow AND dml >= 5 THEN dml || ' DML operations' END, CASE WHEN flow AND subflows > 0 THEN subflows || ' subflow references' END,
    CASE WHEN category = 'apex_trigger' AND body_lines >= 200 THEN body_lines || '-line trigger body' END, CASE WHEN category = 'apex_trigger' AND n_events >= 3 THEN n_events || ' trigger events' END, CASE WHEN category = 'lwc_bundle' THEN CASE classification WHEN 'business_logic_heavy' THEN 'business-logic-heavy LWC' WHEN 'mixed' THEN 'mixed LWC' END END,
    CASE WHEN category = 'lwc_bundle' AND n_imports >= 3 THEN n_imports || ' Apex imports' END, CASE WHEN category = 'validation_rule' AND length(formula) > 200 THEN length(formula) || '-char formula' END, CASE WHEN category = 'formula_field' AND regexp_matches(formula, '^[^.]*[A-Z][^.]*\\.') THEN 'cross-object reference in formula' END, CASE WHEN category = 'formula_field' AND length(formula) > 300 THEN length(formula) || '-char formula' END)"""
_SCORED = f"WITH {_DIM}, c AS (SELECT comp.*, dim.difficulty AS d0, dim.risk AS r0, ends_with(category, '_flow') OR category = 'process_builder' AS flow FROM comp JOIN dim USING (category)), sc AS (SELECT component_id, category, name, CAST(greatest(0, least(100, d0 + {_MODS})) AS INT) AS difficulty, CAST(greatest(0, least(100, r0 + {_RISK})) AS INT) AS risk, {_DRIVERS} AS drivers FROM c)"


@query(_SCORED + " SELECT * FROM sc", "comp")
def complexity_score(spark, comp):
    return corpus.complexity(comp).withColumn("drivers", F.array_join("drivers", ";"))


@query(_SCORED + " SELECT component_id, difficulty, risk, CASE WHEN difficulty < 35 THEN 'b-low' WHEN difficulty < 70 THEN 'b-med' ELSE 'b-high' END AS band FROM sc ORDER BY difficulty DESC, risk DESC, name, component_id LIMIT 100", "comp")
def complexity_heatmap_order(spark, comp):
    return corpus.heatmap(corpus.complexity(comp)).limit(100).select("component_id", "difficulty", "risk", S.band(F.col("difficulty")).alias("band"))


_TIERED = f"""WITH {_DIM}, ti AS (SELECT component_id, category, CASE WHEN (callouts > 0 OR subflows > 0) AND tier = 'tier1_rules' THEN 'tier2_temporal' WHEN decisions >= 20 OR screens > 0 OR classification = 'business_logic_heavy' THEN 'tier3_langgraph' ELSE tier END AS tier,
    CASE WHEN (callouts > 0 OR subflows > 0) AND tier = 'tier1_rules' THEN 0.85::DOUBLE WHEN decisions >= 20 THEN 0.7::DOUBLE WHEN screens > 0 OR classification = 'business_logic_heavy' THEN 0.75::DOUBLE ELSE 0.9::DOUBLE END AS confidence, category IN ('autolaunched_flow', 'record_triggered_flow', 'workflow_rule', 'auto_response_rule') AS dual_target FROM comp JOIN dim USING (category))"""


@query(_TIERED + " SELECT *, CASE tier WHEN 'tier1_rules' THEN 'b-tier1' WHEN 'tier2_temporal' THEN 'b-tier2' ELSE 'b-tier3' END AS tier_class FROM ti", "comp")
def tier_classify(spark, comp):
    return corpus.classify_tier(comp).withColumn("tier_class", S.tier_class(F.col("tier")))


@query(_TIERED + " SELECT count(*) FILTER (tier = 'tier1_rules') AS tier1, count(*) FILTER (tier = 'tier2_temporal') AS tier2, count(*) FILTER (tier = 'tier3_langgraph') AS tier3, count(*) FILTER (dual_target) AS dual FROM ti", "comp")
def manifest_counts(spark, comp):
    return corpus.manifest_counts(corpus.classify_tier(comp))


@query("SELECT component_id, category IN ('autolaunched_flow', 'record_triggered_flow', 'workflow_rule', 'auto_response_rule') AS dual_target FROM comp", "comp")
def dual_target(spark, comp):
    return corpus.classify_tier(comp).select("component_id", "dual_target")


@query(_SCORED + " SELECT c.component_id, CASE WHEN c.component_id % 2 = 0 THEN sc.difficulty ELSE 50 END AS difficulty, CASE WHEN c.component_id % 3 = 0 THEN 'sales' ELSE 'other' END AS domain, CASE WHEN c.component_id % 3 = 0 THEN 'tier2_temporal' ELSE 'tier1_rules' END AS tier FROM c JOIN sc USING (component_id)", "comp")
def component_lookup_defaults(spark, comp):
    notes = comp.filter("component_id % 3 = 0").select("component_id", F.lit("sales").alias("domain"), F.lit("tier2_temporal").alias("recommended_tier"))
    return corpus.lookup_defaults(comp, corpus.complexity(comp).filter("component_id % 2 = 0"), notes).select("component_id", "difficulty", "domain", "tier")


@query(r"""WITH s AS (SELECT page_id, len(regexp_extract_all(source, '@wire\s*\(')) AS wire_calls, len(regexp_extract_all(source, '\bfetch\s*\(')) AS fetch_calls, len(regexp_extract_all(source, '\b(if|else if|switch|case)\b')) AS conditionals, len(regexp_extract_all(source, '\b[A-Za-z_]\w*\s*\(\s*\{[^}]*\}\s*\)\s*\.then\b')) AS imperative_calls, length(source) - length(replace(source, chr(10), '')) + 1 AS lines FROM script)
    SELECT page_id, CAST(wire_calls AS INT) AS wire_calls, CAST(fetch_calls AS INT) AS fetch_calls, CAST(conditionals AS INT) AS conditionals, CAST(imperative_calls AS INT) AS imperative_calls, CAST(lines AS INT) AS lines,
    CASE WHEN imperative_calls * 3 + wire_calls + conditionals + fetch_calls = 0 AND lines < 50 THEN 'ui_only' WHEN imperative_calls * 3 + wire_calls + conditionals + fetch_calls >= 8 OR lines >= 200 THEN 'business_logic_heavy' ELSE 'mixed' END AS classification FROM s""", "script")
def script_signals(spark, script):
    return corpus.script_signals(script).select("page_id", "wire_calls", "fetch_calls", "conditionals", "imperative_calls", "lines", "classification")


@query("SELECT o_orderkey, lower(CASE WHEN o_orderkey % 3 = 0 THEN 'Before' ELSE 'after' END) AS timing, 'Obj' || o_custkey AS object, 'insert,update' AS events FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 4 = 0", "orders")
def trigger_headers(spark, orders):
    body = F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'class X {}' ELSE concat('TRIGGER T on Obj', o_custkey, ' (', CASE WHEN o_orderkey % 3 = 0 THEN 'Before' ELSE 'after' END, ' Insert, update) { }') END")
    head = orders.select("o_orderkey", corpus.trigger_header(body).alias("h"))
    return head.select("o_orderkey", "h.timing", "h.object", joined("h.events").alias("events"))


# --- validators and texts ---------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z][A-Za-z0-9_]*') AS identifier, regexp_full_match(x, '[A-Za-z][A-Za-z0-9_]*') AND length(x) <= 80 AS custom, length(y) IN (15, 18) AS record_id, true AS path, false AS hostile
    FROM (SELECT *, replace(p_name, ' ', '_') || '__c' AS x, 'a0' || lpad(CAST(p_partkey AS VARCHAR), CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 13 WHEN 1 THEN 16 ELSE 14 END, '0') AS y FROM part)""", "part")
def soql_validators(spark, part):
    x = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("__c"))
    y = F.expr("concat('a0', lpad(CAST(p_partkey AS STRING), CASE p_partkey % 3 WHEN 0 THEN 13 WHEN 1 THEN 16 ELSE 14 END, '0'))")
    path = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".Owner.Name"))
    return part.select("p_partkey", S.is_identifier(F.col("p_name")).alias("identifier"), S.is_identifier(x).alias("custom"), S.is_record_id(y).alias("record_id"), S.is_field_path(path).alias("path"), S.is_identifier(F.concat(x, F.lit("\n"))).alias("hostile"))


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderkey % 50 = 0) THEN NULL ELSE string_agg('''' || lpad(CAST(o_orderkey AS VARCHAR), 15, '0') || '''', ',' ORDER BY o_orderkey) END AS ids FROM orders GROUP BY 1""", "orders")
def soql_in_list(spark, orders):
    key = F.when(F.col("o_orderkey") % 50 == 0, F.lit("bad id")).otherwise(F.lpad(F.col("o_orderkey").cast("string"), 15, "0"))
    return orders.groupBy("o_custkey").agg(S.in_list(F.array_sort(F.collect_list(key))).alias("ids"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE '{"a": ' || doc_id || '}' END AS found FROM documents""", "documents")
def json_from_text(spark, documents):
    text = F.expr("""CASE doc_id % 3 WHEN 0 THEN concat('say ```json\n{"a": ', doc_id, '}\n``` done') WHEN 1 THEN concat('so {"a": ', doc_id, '} it is') ELSE 'none' END""")
    return documents.select("doc_id", S.json_in_text(text).alias("found"))


@query("""SELECT doc_id, left(summary, 300) AS summary, domain, complexity_band, recommended_tier, confidence FROM (SELECT doc_id, repeat('s', CAST(doc_id % 400 AS INT)) AS summary, CASE WHEN doc_id % 2 = 0 THEN 'sales' ELSE 'other' END AS domain, 'high' AS complexity_band, CASE WHEN doc_id % 5 = 0 THEN 'tier2_temporal' ELSE 'tier1_rules' END AS recommended_tier, 0.25::DOUBLE AS confidence FROM documents)""", "documents")
def annotation_defaults(spark, documents):
    reply = F.expr("""concat('{"summary": "', repeat('s', CAST(doc_id % 400 AS INT)), '", "domain": "', CASE WHEN doc_id % 2 = 0 THEN 'sales' ELSE 'odd' END, '", "complexity_band": "high", "recommended_tier": "', CASE WHEN doc_id % 5 = 0 THEN 'tier2_temporal' ELSE 'x' END, '", "confidence": 0.25}')""")
    return corpus.annotations(documents.select("doc_id", reply.alias("reply")), ["sales", "service"])


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}') AS content_hash, regexp_replace(p_name, '[^0-9A-Za-z_]', '_', 'g') AS safe FROM part""", "part")
def content_sha256(spark, part):
    fixed = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size")), {"ignoreNullFields": "false"})
    return part.select("p_partkey", F.sha2(fixed, 256).alias("content_hash"), S.safe_identifier(F.col("p_name")).alias("safe"))


# --- graph ------------------------------------------------------------------------------------------------------


@query("SELECT n AS node, CAST(count(*) + 1 AS BIGINT) AS degree FROM (SELECT src AS n FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1", "edges")
def graph_degree(spark, edges):
    return graph.degree(graph.all_nodes(spark.createDataFrame([], "node string"), edges), edges)


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS src, 'Cls' || l_partkey AS a FROM lineitem) SELECT src, component_id AS dst, 'calls' AS kind FROM b JOIN comp ON a = api_name WHERE component_id % 2 = 0""", "lineitem", "comp")
def graph_calls_edges(spark, lineitem, comp):
    bundles = lineitem.groupBy(F.col("l_orderkey").alias("component_id")).agg(F.collect_list(F.expr("concat('Cls', l_partkey, '.run')")).alias("imports"))
    return graph.call_edges(bundles, comp.filter("component_id % 2 = 0"))


@query("""SELECT DISTINCT l_orderkey AS src, 'Cls' || l_partkey || '.run' AS import FROM lineitem WHERE l_partkey % 2 = 1""", "lineitem", "comp")
def graph_skipped_imports(spark, lineitem, comp):
    bundles = lineitem.groupBy(F.col("l_orderkey").alias("component_id")).agg(F.collect_set(F.expr("concat('Cls', l_partkey, '.run')")).alias("imports"))
    return graph.skipped_imports(bundles, comp.filter("component_id % 2 = 0"))


@query("""SELECT DISTINCT node FROM (SELECT 'cmt:o' || o_custkey AS node FROM orders JOIN comp ON api_name = 'Cls' || o_custkey UNION ALL SELECT CAST(component_id AS VARCHAR) FROM comp)""", "orders", "comp")
def graph_hub_union(spark, orders, comp):
    edges = orders.select(F.expr("concat('o', o_custkey)").alias("dispatcher"), F.expr("concat('Cls', o_custkey)").alias("handler"), F.lit(1.0).alias("confidence"))
    hubs = graph.dispatch_graph(edges, comp).select("src", F.col("dst").cast("string").alias("dst"))
    return graph.all_nodes(comp.select(F.col("component_id").cast("string").alias("node")), hubs)


# a component's smallest node has no smaller neighbour, so only such nodes need to spread
@query("""WITH b AS (SELECT DISTINCT src, dst FROM chain UNION SELECT dst, src FROM chain), s AS (SELECT src FROM b GROUP BY 1 HAVING min(dst) >= src), r AS (SELECT src AS node, src AS c FROM s UNION SELECT b.dst, r.c FROM r JOIN b ON b.src = r.node)
    SELECT node, min(c) AS component FROM r GROUP BY 1""", "chain")
def graph_components(spark, chain):
    return graph.components(chain)


SQL["graph_components"] = SQL["graph_components"].replace("WITH chain", "WITH RECURSIVE chain", 1)


@query(None, "chain")
def graph_communities(spark, chain):
    return graph.communities(chain)


@query(None, "chain")
def business_processes(spark, chain):
    members = graph.communities(chain)
    return graph.business_processes(members, members.select("node", F.expr("concat('cat', node % 3)").alias("category")))


# --- logs -------------------------------------------------------------------------------------------------------

_CLS = r"""cl AS (SELECT file, line_no, regexp_extract(value, '^(\d{2}:\d{2}:\d{2}\.\d+)\s+\((\d+)\)\|(.*)$', 3) AS body, CASE WHEN value LIKE '10:%' THEN CASE split_part(regexp_extract(value, '^[^|]*\|(.*)$', 1), '|', 1) WHEN 'EXECUTION_STARTED' THEN 'execution_started' WHEN 'EXECUTION_FINISHED' THEN 'execution_finished' WHEN 'DML_BEGIN' THEN 'dml_begin' WHEN 'FLOW_START_INTERVIEW_BEGIN' THEN 'flow_start' WHEN 'VALIDATION_FAIL' THEN 'validation_fail' WHEN 'VALIDATION_PASS' THEN 'validation_pass' WHEN 'USER_INFO' THEN 'user_info' END END AS kind FROM lines)"""
_TXN = _CLS + """, st AS (SELECT *, CAST(sum(CASE WHEN kind = 'execution_started' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) AS BIGINT) AS txn FROM cl WHERE kind IS NOT NULL),
    cd AS (SELECT *, coalesce(sum(CASE WHEN kind = 'execution_finished' THEN 1 ELSE 0 END) OVER (PARTITION BY file, txn ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM st), inn AS (SELECT * FROM cd WHERE txn > 0 AND closed = 0)"""
_FAIL = r"list(regexp_extract(body, 'VALIDATION_FAIL\|.*?Name:([\w.]+)', 1) ORDER BY line_no) FILTER (kind = 'validation_fail')"


@query(f"WITH {_CLS} SELECT file, line_no, kind FROM cl", "lines")
def log_classify(spark, lines):
    return logs.classify(lines).select("file", "line_no", "kind")


@query(f"WITH {_CLS} SELECT file, count(kind) AS classified, count(*) FILTER (kind IS NULL) AS unclassified FROM cl GROUP BY 1", "lines")
def log_stats(spark, lines):
    return logs.parse_stats(logs.classify(lines))


@query(f"""WITH {_TXN} SELECT file, txn, count(*) FILTER (kind <> 'execution_started') AS n_events, count(*) FILTER (kind = 'dml_begin') AS n_dml, coalesce(array_to_string({_FAIL}, ','), '') AS failures, coalesce(string_agg(split_part(body, '|', 3), ',' ORDER BY line_no) FILTER (kind = 'flow_start'), '') AS flows, max(split_part(body, '|', 3)) FILTER (kind = 'user_info') AS user_id FROM inn GROUP BY 1, 2""", "lines")
def log_transactions(spark, lines):
    done = logs.transactions(logs.sessions(logs.classify(lines)))
    return done.select("file", "txn", "n_events", "n_dml", joined("failures").alias("failures"), joined("flows").alias("flows"), "user_id")


@query(rf"""WITH {_TXN} SELECT file, txn, line_no, regexp_extract(body, 'Op:(\w+)', 1) AS op, CAST(regexp_extract(body, 'Rows:(\d+)', 1) AS INT) AS n_rows FROM inn WHERE kind = 'dml_begin'""", "lines")
def log_dml_ops(spark, lines):
    return logs.dml_ops(logs.sessions(logs.classify(lines))).select("file", "txn", "line_no", "op", "n_rows")


_COMPARED = f"""{_TXN}, t AS (SELECT file, txn, coalesce({_FAIL}, []) AS l FROM inn GROUP BY 1, 2), cmp AS (SELECT file, txn, list_sort(list_filter(l, lambda x: x <> 'Rule_1')) AS ol, CASE WHEN list_contains(l, 'Rule_1') THEN [] ELSE ['Rule_1'] END AS orr FROM t)"""


def _compared(lines):
    done = logs.transactions(logs.sessions(logs.classify(lines)))
    return logs.compare(done, done.select("file", "txn", F.array(F.lit("Rule_1")).alias("failed")))


@query(f"WITH {_COMPARED} SELECT file, txn, array_to_string(ol, ',') AS only_in_log, array_to_string(orr, ',') AS only_in_rules, len(ol) + len(orr) > 0 AS diverged, CAST(CASE WHEN len(ol) + len(orr) > 0 THEN 50 ELSE 0 END AS INT) AS severity FROM cmp", "lines")
def log_compare(spark, lines):
    return _compared(lines).select("file", "txn", joined("only_in_log").alias("only_in_log"), joined("only_in_rules").alias("only_in_rules"), "diverged", "severity")


_LISTED = "'[' || array_to_string(list_transform({0}, lambda x: chr(39) || x || chr(39)), ', ') || ']'"


@query(f"""WITH {_COMPARED}, pick AS (SELECT file, txn, l, CASE WHEN txn % 2 = 0 THEN ['v_amount'] ELSE []::VARCHAR[] END AS r FROM t), d AS (SELECT *, list_sort(list_distinct(list_filter(l, lambda x: NOT list_contains(r, x)))) AS ol, list_sort(list_filter(r, lambda x: NOT list_contains(l, x))) AS orr FROM pick)
    SELECT file, txn, array_to_string(r, ',') AS failed, len(r) > 0 AS aborted, len(ol) + len(orr) > 0 AS diverged, CASE WHEN len(ol) + len(orr) = 0 THEN 'runtime + log agree on validation outcomes' ELSE concat_ws('; ', CASE WHEN len(orr) > 0 THEN 'runtime fired but log did not: ' || {_LISTED.format("orr")} END,
      CASE WHEN len(ol) > 0 THEN 'log fired but runtime did not: ' || {_LISTED.format("ol")} END, CASE WHEN len(r) > 0 AND len(l) = 0 THEN 'runtime aborted; production accepted the txn' END) END AS explanation FROM d""", "lines")
def log_replay(spark, lines):
    """The rules run over each transaction's record, and their failures meet those of the log."""
    done = logs.transactions(logs.sessions(logs.classify(lines)))
    states = done.select("file", "txn", F.when(F.col("txn") % 2 == 0, 10_000).otherwise(90_000).alias("Amount"), F.lit("F").alias("Stage"))
    return logs.replay(done, states, _OPP_RULES[:2]).select("file", "txn", joined("failed").alias("failed"), "aborted", "diverged", "explanation")


@query(f"WITH {_COMPARED} SELECT count(*) AS total, count(*) FILTER (len(ol) + len(orr) > 0) AS diverged, CAST(floor(count(*) FILTER (len(ol) + len(orr) = 0) * 100 / count(*)) AS BIGINT) AS clean_percent FROM cmp", "lines")
def log_replay_summary(spark, lines):
    return logs.replay_summary(_compared(lines))


@query(f"WITH {_CLS} SELECT line_no, 1704103200000 + CASE WHEN kind = 'execution_started' THEN 100 WHEN kind IN ('user_info', 'validation_pass') THEN 250 WHEN kind = 'dml_begin' THEN 1500 WHEN kind = 'execution_finished' THEN 3000 ELSE 2000 END AS at_ms FROM cl WHERE kind IS NOT NULL", "lines")
def log_times(spark, lines):
    at = logs.timestamps(logs.classify(lines).filter("kind is not null"), "2024-01-01")
    return at.select("line_no", F.unix_millis("at").alias("at_ms"))
