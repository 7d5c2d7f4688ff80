"""Readiness scores over observation logs, lag, transitions and routing tables.

Observations: process_id, observed_at, diverged, severity. Times are given, never taken from the clock.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnflow import model as M
from cairnflow.functions import scalar as S


def in_window(obs: DataFrame, now: str, days: int = M.WINDOW_DAYS) -> DataFrame:
    """From ``days`` before ``now``, inclusive; no upper bound."""
    return obs.filter(F.col("observed_at") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def score_columns(total: Column, diverged: Column, severity: Column) -> Column:
    """0 to 100: the share of clean events less half the diverged events' severity; half to even."""
    n = F.greatest(total, F.lit(1)).cast("double")
    raw = F.lit(100.0) * (total - diverged) / n - F.lit(0.5) * severity / n
    return F.when(total == 0, 0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.rint(raw)))).cast("int")


def readiness(obs: DataFrame, by: str = "process_id", days: int = M.WINDOW_DAYS) -> DataFrame:
    """One row a process: totals, avg_severity, score, eligible, reason."""
    sums = obs.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if("diverged").alias("diverged_events"), F.coalesce(F.sum(F.when(F.col("diverged"), F.col("severity"))), F.lit(0)).cast("long").alias("_sev")
    )
    total, diverged = F.col("total_events"), F.col("diverged_events")
    avg = F.when(diverged > 0, F.col("_sev") / diverged).otherwise(0.0)
    scored = sums.withColumn("score", score_columns(total, diverged, F.col("_sev"))).withColumn("avg_severity", avg)
    enough, good = total >= M.MIN_EVENTS, F.col("score") >= M.ELIGIBLE
    reason = (
        F.when(~enough, F.concat(F.lit("only "), total.cast("string"), F.lit(f" events in {days}-day window; need {M.MIN_EVENTS} for eligibility")))
        .when(~good, F.concat(F.lit("score "), F.col("score").cast("string"), F.lit(f" < threshold {M.ELIGIBLE}")))
        .otherwise(F.concat(F.lit("score "), F.col("score").cast("string"), F.lit(f" >= {M.ELIGIBLE} on "), total.cast("string"), F.lit(" events")))
    )
    return scored.select(by, "total_events", (total - diverged).alias("clean_events"), "diverged_events", "avg_severity", "score", (enough & good).alias("eligible"), reason.alias("reason"))


def rolling(obs: DataFrame, days: int = M.WINDOW_DAYS) -> DataFrame:
    """By process and day: events, diverged events and score of the ``days`` days up to it. Days are summed first,
    so the window runs over one row a day and process."""
    daily = obs.groupBy("process_id", F.to_date("observed_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("diverged").alias("d"), F.coalesce(F.sum(F.when(F.col("diverged"), F.col("severity"))), F.lit(0)).alias("s")
    )
    frame = W.partitionBy("process_id").orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    total, diverged, severity = (F.sum(c).over(frame) for c in "nds")
    return daily.select("process_id", "day", total.alias("total_events"), diverged.alias("diverged_events"), score_columns(total, diverged, severity).alias("score"))


def newest(rows: DataFrame, k: int, at: str, *ties: str) -> DataFrame:
    """The ``k`` newest rows, a fixed order among equal times."""
    return rows.orderBy(F.col(at).desc(), *(F.col(c).desc() for c in ties)).limit(k)


def lag(events: DataFrame, now: str, at: str = "observed_at", threshold: int = M.LAG_HOURS) -> DataFrame:
    """By process: the last event, hours since, and whether to reconcile (strictly over the threshold)."""
    moment = F.lit(now).cast("timestamp_ntz")
    last = events.groupBy("process_id").agg(F.max(at).alias("last_event_at"))
    hours = (F.unix_micros(moment.cast("timestamp")) - F.unix_micros(F.col("last_event_at").cast("timestamp"))) / F.lit(3.6e9)
    return last.select("process_id", "last_event_at", hours.alias("lag_hours"), (hours > threshold).alias("needs_reconciliation"), F.when(hours.isNull(), "no_events").when(hours > threshold, "needs_reconciliation").otherwise("ok").alias("status"))


def decide(config: DataFrame, scores: DataFrame, now: str) -> DataFrame:
    """The transition of each routed process: kind, to_percent, reason, requires_human_signoff.

    A process without a score counts as 0; one with a score but no configuration is held."""
    joined = config.join(scores.select("process_id", "score", "eligible"), "process_id", "full")
    pct, score = F.coalesce("stage_percent", F.lit(0)), F.coalesce("score", F.lit(0))
    text = score.cast("string")
    ahead, back = S.next_stage(pct), S.previous_stage(pct)
    done = S.dwell_remaining_s(pct, F.col("entered_stage_at"), F.lit(now).cast("timestamp_ntz")) == 0
    say = lambda *xs: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in xs))
    rule = lambda kind, to, reason, sign=False: F.struct(F.lit(kind).alias("kind"), to.cast("int").alias("to_percent"), reason.alias("reason"), F.lit(sign).alias("requires_human_signoff"))
    hold = F.when(ahead.isNull(), "already at 100%").when(score < M.ADVANCE, say("score ", text, f" < advance_threshold {M.ADVANCE}")).when(~done, "dwell incomplete").otherwise("not cutover-eligible per readiness scorer")
    decision = (
        F.when(F.col("stage_percent").isNull(), rule("hold", F.lit(0), F.lit("no routing config")))
        .when(score < M.IMMEDIATE, rule("immediate_rollback", F.lit(0), say("score ", text, f" < immediate_rollback_threshold {M.IMMEDIATE}; requires human sign-off"), True))
        .when((score < M.ROLLBACK) & (pct > 0), rule("rollback", back, say("score ", text, f" < rollback_threshold {M.ROLLBACK}; reverting to ", back.cast("string"), "%")))
        .when((score >= M.ADVANCE) & done & ahead.isNotNull() & F.coalesce("eligible", F.lit(False)), rule("advance", ahead, say("score ", text, f" >= {M.ADVANCE} + dwell complete")))
        .otherwise(rule("hold", pct, hold))
    )
    return joined.select("process_id", pct.alias("from_percent"), score.alias("readiness_score"), decision.alias("d")).select("process_id", "from_percent", "readiness_score", "d.*")


def apply_decisions(config: DataFrame, decisions: DataFrame, now: str, signed_off: list[str] = (), compensated: DataFrame | None = None) -> DataFrame:
    """The configuration after the decisions. What needs a sign-off happens for processes in ``signed_off``; where
    ``compensated`` (process_id, ok) says that undoing failed, a rollback waits. A change restarts the dwell time."""
    allowed = ~F.col("requires_human_signoff") | F.col("process_id").isin(list(signed_off)) if signed_off else ~F.col("requires_human_signoff")
    rows = config.join(decisions.select("process_id", "kind", "to_percent", "requires_human_signoff"), "process_id", "left")
    if compensated is not None:
        rows = rows.join(compensated.select("process_id", "ok"), "process_id", "left")
        allowed &= F.coalesce("ok", F.lit(True)) | ~F.col("kind").contains("rollback")
    moves = F.coalesce((F.col("kind") != "hold") & allowed, F.lit(False))
    return rows.select(
        "process_id", F.when(moves, F.col("to_percent")).otherwise(F.col("stage_percent")).alias("stage_percent"),
        F.coalesce("hash_seed", F.concat("process_id", F.lit("_seed"))).alias("hash_seed"),
        F.when(moves, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("entered_stage_at")).alias("entered_stage_at"),
    )


def begin(processes: DataFrame, now: str) -> DataFrame:
    """Configurations at 1 percent, seeded by the process where no seed is given."""
    seed = F.coalesce("hash_seed", "process_id") if "hash_seed" in processes.columns else F.col("process_id")
    return processes.select("process_id", F.lit(1).alias("stage_percent"), seed.alias("hash_seed"), F.lit(now).cast("timestamp_ntz").alias("entered_stage_at"))


def instant_rollback(config: DataFrame, process_ids: list[str], now: str) -> DataFrame:
    hit = F.col("process_id").isin(process_ids)
    return config.select("process_id", F.when(hit, 0).otherwise(F.col("stage_percent")).alias("stage_percent"), "hash_seed", F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("entered_stage_at")).alias("entered_stage_at"))


def regressions(config: DataFrame, scores: DataFrame) -> DataFrame:
    """Processes that run fully on the new side and score below the alarm."""
    return config.filter("stage_percent = 100").join(scores.filter(F.col("score") < M.REGRESSION).select("process_id", "score"), "process_id")


def route(records: DataFrame, config: DataFrame, bucket=S.bucket_md5) -> DataFrame:
    """Each (process_id, record_id) with the side it goes to: runtime if its bucket is below the process's percent.
    The configuration has a row a process; the planner broadcasts it where it is small."""
    joined = records.join(config.select("process_id", "stage_percent", "hash_seed"), "process_id", "left")
    place = bucket(S.routing_key(F.coalesce("hash_seed", "process_id"), F.col("process_id"), F.col("record_id")))
    runtime = F.coalesce(place < F.col("stage_percent"), F.lit(False))
    return joined.select("process_id", "record_id", F.when(runtime, "runtime").otherwise("production").alias("routed_to"), F.coalesce("stage_percent", F.lit(0)).alias("stage_percent"))


def quota(allocations: DataFrame, remaining: int | None) -> DataFrame:
    """process_id, share, remaining_for, utilization for weights and consumption; without a snapshot nothing is left."""
    part = F.lit(remaining) * (F.col("weight") / allocations.agg(F.sum("weight")).scalar())
    share = F.when(F.lit(remaining).isNull(), 0).otherwise(F.floor(part))
    return allocations.select("process_id", share.cast("long").alias("share"), F.greatest(share - F.col("consumed"), F.lit(0)).cast("long").alias("remaining_for"), F.when(part > 0, F.col("consumed") / part).otherwise(1.0).alias("utilization"))


def admit(requests: DataFrame, shares: DataFrame) -> DataFrame:
    """Which requests (process_id, seq, cost) a process's budget admits, in order; a refused one costs nothing.

    Rows are sorted by process and seq (ties by cost) and met one by one, so a task holds a batch and one budget
    however many requests a process has. A process without a share has none; a null cost has no decision."""
    placed = requests.join(shares.select("process_id", F.col("remaining_for").alias("budget")), "process_id", "left")
    rows = placed.select("process_id", F.col("seq").cast("long").alias("seq"), "cost", F.coalesce("budget", F.lit(0)).cast("long").alias("budget"))

    def run(batches):
        held, left = None, 0
        for batch in batches:
            out = []
            for process, cost, budget in zip(*(batch.column(c).to_pylist() for c in ("process_id", "cost", "budget"))):
                if held != (process,):
                    held, left = (process,), budget
                out.append(None if cost is None else cost <= left)
                left -= cost if out[-1] else 0
            yield pa.RecordBatch.from_arrays([batch.column("process_id"), batch.column("seq"), pa.array(out, pa.bool_())], ["process_id", "seq", "admitted"])

    kind = rows.schema["process_id"].dataType.simpleString()
    return rows.repartition("process_id").sortWithinPartitions("process_id", "seq", "cost").mapInArrow(run, f"process_id {kind}, seq long, admitted boolean")


def admit_units(requests: DataFrame, shares: DataFrame) -> DataFrame:
    """``admit`` where every request costs one: the first ``remaining_for`` of each process."""
    place = F.row_number().over(W.partitionBy("process_id").orderBy("seq"))
    return requests.join(shares.select("process_id", "remaining_for"), "process_id", "left").select("process_id", "seq", (place <= F.coalesce("remaining_for", F.lit(0))).alias("admitted"))


def compensate(activities: DataFrame) -> DataFrame:
    """Undo a saga's activities (saga_id, seq, kind, has_fn, raises) from the last to the first: outcome of each.

    A manual activity stops the rest, which stay pending; log_only needs nothing; a missing or failing function is
    a failure that does not stop the others."""
    later = W.partitionBy("saga_id").orderBy(F.col("seq").desc()).rowsBetween(W.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(F.col("kind") == "requires_human").over(later), F.lit(False))
    outcome = F.when(stopped, "pending").when(F.col("kind") == "requires_human", "paused").when(F.col("kind") == "log_only", "ok").when(~F.col("has_fn"), "failed").when(F.col("raises"), "failed").otherwise("ok")
    return activities.select("saga_id", "seq", "kind", outcome.alias("outcome"))


def saga_outcomes(compensated: DataFrame) -> DataFrame:
    return compensated.groupBy("saga_id").agg(F.count_if(F.col("outcome") == "ok").alias("n_ok"), F.count_if(F.col("outcome") == "failed").alias("n_failed"), F.max(F.col("outcome") == "paused").alias("paused"), F.min(F.col("outcome") == "ok").alias("fully_compensated"))


def parity_counts(findings: DataFrame) -> DataFrame:
    """dimension, value, n by category (zero where none), disposition and severity, in one pass."""
    counts = findings.groupingSets([["category"], ["customer_disposition"], ["severity"]], "category", "customer_disposition", "severity").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    seen = counts.select(F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "disposition").otherwise("severity").alias("dimension"), F.coalesce("category", "customer_disposition", "severity").alias("value"), "n")
    every = findings.sparkSession.createDataFrame([("category", c) for c in M.PARITY_CATEGORIES], "dimension string, value string")
    return seen.unionByName(every.withColumn("n", F.lit(0).cast("long"))).groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def parity_findings(divergences: DataFrame) -> DataFrame:
    """A finding for each category of observed divergences (id, category, diffs): the sample is its first row."""
    first = divergences.groupBy("category").agg(F.min_by("diffs", "id").alias("diffs"))
    shown = lambda side: F.array_join(F.transform(F.array_sort(F.map_keys("diffs")), lambda k: F.concat(k, F.lit("="), F.coalesce(F.col("diffs")[k][side], F.lit("None")))), ", ")
    severe = F.col("category").isin("translation_error", "ooe_ordering_mismatch")
    return first.select(
        F.concat(F.lit("divergence-"), "category").alias("finding_id"), F.lit("discovered_undocumented").alias("category"), F.concat(F.lit("Production produced: "), shown("production")).alias("production_behavior"),
        F.concat(F.lit("Runtime produced: "), shown("runtime")).alias("runtime_behavior"), F.concat(F.lit("Observed during shadow execution; categorized as "), "category", F.lit(".")).alias("rationale"),
        F.when(severe, "major").otherwise("minor").alias("severity"), F.lit("open").alias("customer_disposition"),
    )


def _expected(rows: DataFrame, finding_id: Column, category: str, production: Column, runtime: str, rationale: str, severity: str) -> DataFrame:
    return rows.select(
        finding_id.alias("finding_id"), F.lit(category).alias("category"), production.alias("production_behavior"), F.lit(runtime).alias("runtime_behavior"), F.lit(rationale).alias("rationale"),
        F.lit(severity).alias("severity"), F.lit("open").alias("customer_disposition"),
    )


def excluded_step_findings(audit: DataFrame) -> DataFrame:
    """A finding for each step of an audit (step, step_name, in_scope) that is out of scope."""
    production = F.concat(F.lit("OoE step "), F.col("step").cast("string"), F.lit(" ("), "step_name", F.lit(") executes for matching transactions"))
    why = "No component exercises the step, so it is left out and refused where it turns up."
    return _expected(audit.filter("not in_scope"), F.concat(F.lit("excluded-step-"), F.col("step").cast("string")), M.PARITY_CATEGORIES[0], production, "Runtime explicitly refuses transactions exercising this step (StepNotInScopeError)", why, "info")


def limit_findings(limits: DataFrame) -> DataFrame:
    """A finding for each platform limit (limit) that production has and the runtime has not."""
    production = F.concat(F.lit("Production enforces governor limit: "), "limit")
    runtime = "Runtime does not enforce this limit; transactions that would exceed it in production execute to completion externally"
    return _expected(limits, F.concat(F.lit("limit-"), "limit"), M.PARITY_CATEGORIES[2], production, runtime, "Doing without the platform's limits is meant.", "minor")


def nearest_rank(samples: DataFrame, value: str, percents: list[int], by: list[str] = ()) -> DataFrame:
    """Latency percentiles: the element at index int(n * p / 100), clamped, of the sorted samples. Found by rank
    over distinct values and their counts, not by collecting a group."""
    counts = samples.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    order = W.partitionBy(*by).orderBy(value)
    ranked = counts.withColumn("_upto", F.sum("_c").over(order)).withColumn("_n", F.sum("_c").over(W.partitionBy(*by)))
    index = lambda p: F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1)
    picks = [F.min(F.when(F.col("_upto") > index(p), F.col(value))).alias(f"p{p}") for p in percents]
    return ranked.groupBy(*by).agg(*picks)
