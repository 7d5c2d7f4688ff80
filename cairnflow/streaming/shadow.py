"""Change events run through the rules with the state of each record, as a stream and in batch.

The batch form needs no state of its own where no rule reads a field outside of the events' schema: every event
carries all of its fields, so each can be judged alone, and the last one of a record leaves its state. The stream
keeps each record's state and works for any rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import MapType, StringType, StructField, StructType

from cairnflow.operators import cdc

#: A rule over a record as a dict: the fields it sets, or a message if the record fails it.
RecordRule = Callable[[dict], "dict | str | None"]
OBSERVED = "replay_id string, sobject string, record_id string, change_type string, diverged boolean, category string, severity int, state map<string,string>"


def judge(record: dict, rules: list[RecordRule]) -> tuple[dict, list[str]]:
    """The record after the rules, and the messages of those it fails; later rules see what earlier ones set."""
    after, failed = dict(record), []
    for rule in rules:
        outcome = rule(after)
        if isinstance(outcome, str):
            failed.append(outcome)
        elif outcome:
            after.update(outcome)
    return after, failed


def _numeric(x: str | None) -> bool:
    return x is not None and x.replace(".", "", 1).lstrip("-").isdigit()


def observe(change_type: str, before: dict, after: dict, failed: list[str]) -> tuple[bool, str | None, int]:
    """diverged, category and severity, as ``functions.scalar.categorise`` has them for such traces."""
    if change_type.startswith("GAP_"):
        return True, "gap_event_full_refetch_required", 80
    diffs = [(before.get(k) or None, after.get(k) or None) for k in {*before, *after}]
    diffs = [d for d in diffs if d[0] != d[1]]
    if failed:
        return True, "translation_error", 50
    if not diffs:
        return False, None, 0
    if all(_numeric(a) or _numeric(b) for a, b in diffs):
        return True, "formula_edge_case", 40
    return True, "translation_error", 50


def step(state: dict | None, event: dict, rules: list[RecordRule]) -> tuple[dict | None, tuple[bool, str | None, int]]:
    """The state after an event, and what was observed. Gaps leave the state, deletions clear it; an event whose
    record fails a rule still writes what the rules had set."""
    kind = event["change_type"]
    if kind.startswith("GAP_"):
        return state, observe(kind, {}, {}, [])
    before = {**(state or {}), **event["fields"], "Id": event["record_id"]}
    after, failed = judge(before, rules)
    return (None if kind == "DELETE" else after), observe(kind, before, after, failed)


class RecordState(StatefulProcessor):
    """Keeps one record's fields."""

    def __init__(self, rules: list[RecordRule]):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("record", StructType([StructField("fields", MapType(StringType(), StringType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        now = dict(self.state.get()[0]) if self.state.exists() else None
        out = []
        events = pd.concat(list(rows)).sort_values("replay_id")
        for event in events.to_dict("records"):
            event["fields"] = dict(event["fields"] or {})
            now, seen = step(now, event, self.rules)
            out.append((event["replay_id"], key[0], key[1], event["change_type"], *seen, None if now is None else list(now.items())))
        if now is None:
            self.state.clear()
        else:
            self.state.update((now,))
        names = [c.split()[0] for c in OBSERVED.split(", ")]
        frame = pd.DataFrame(out, columns=names)
        frame["state"] = [None if s is None else dict(s) for s in frame["state"]]
        yield frame

    def close(self) -> None:
        pass


def shadow_stream(events: DataFrame, rules: list[RecordRule]) -> DataFrame:
    """Observations of a stream of events, with the state each leaves. State is dealt by record."""
    return events.groupBy("sobject", "record_id").transformWithStateInPandas(RecordState(rules), OBSERVED, "Append", "None")


def shadow_batch(events: DataFrame, rules: list[RecordRule]) -> DataFrame:
    """The same for a table of events: a record's events in order of replay id. A record's whole history meets in
    one task here; ``shadow_columns`` has no such bound and is to be preferred where its rules allow."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        now, out = None, []
        for event in frame.sort_values("replay_id").to_dict("records"):
            event["fields"] = dict(event["fields"] or {})
            now, seen = step(now, event, rules)
            out.append((event["replay_id"], key[0], key[1], event["change_type"], *seen, now))
        return pd.DataFrame(out, columns=[c.split()[0] for c in OBSERVED.split(", ")])

    return events.groupBy("sobject", "record_id").applyInPandas(run, OBSERVED)


def shadow_columns(events: DataFrame, ruled: Column, aborted: Column | None = None, reason: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Observations and final state for rules given as columns over the events' own fields."""
    aborted = F.lit(False) if aborted is None else aborted
    seen = cdc.observe(events, ruled, aborted, F.lit(None).cast("string") if reason is None else reason)
    after = events.withColumn("fields", ruled)
    return seen, cdc.last_state(after)


def readiness_log(observed: DataFrame, process_id: str, at: str = "commit_ts") -> DataFrame:
    """Observations as the rows that readiness is scored on."""
    return observed.select(F.lit(process_id).alias("process_id"), F.col(at).alias("observed_at"), "diverged", "severity", "replay_id")


def run_once(observed: DataFrame, out: str, checkpoint: str) -> None:
    """Write a stream's observations to a Parquet log: what is there now, each event once across restarts."""
    query = observed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_both(observed: DataFrame, divergences: str, readiness: str, checkpoint: str):
    """One query that appends to both logs from the same micro-batch."""

    def write(batch: DataFrame, _: int) -> None:
        batch.filter("diverged").write.mode("append").parquet(divergences)
        batch.select("sobject", "record_id", "replay_id", "diverged", "severity").write.mode("append").parquet(readiness)

    return observed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
