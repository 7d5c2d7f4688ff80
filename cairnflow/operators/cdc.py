"""Change-data-capture events and record state, in batch.

Events: replay_id, sobject, record_id, change_type, commit_ts, fields map<string,string>. Events of a record are
ordered by replay_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow import model as M
from cairnflow.functions import scalar as S
from cairnflow.operators import graph

KEY = ["sobject", "record_id"]


def topic(entity: Column) -> Column:
    return F.concat(F.lit("/data/"), entity, F.lit("ChangeEvent"))


def subscribed(events: DataFrame, topics: list[str]) -> DataFrame:
    """Events of the given topics; none given means all."""
    return events.filter(topic(F.col("sobject")).isin(topics)) if topics else events


def gaps(events: DataFrame) -> DataFrame:
    return events.filter(S.is_gap(F.col("change_type")))


def overlay(state: Column, fields: Column, record_id: Column) -> Column:
    """The state with the event's fields on top, nulls included, and the record's id."""
    top = F.map_concat(F.map_filter(fields, lambda k, v: k != "Id"), F.create_map(F.lit("Id"), record_id))
    kept = F.map_filter(F.coalesce(state, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~F.map_contains_key(top, k))
    return F.map_concat(kept, top)


def last_state(events: DataFrame, keep_deleted: bool = False) -> DataFrame:
    """The state of each record after its last event: every event that writes carries all fields of its schema, so
    the last one decides. Gaps write nothing, a deletion clears. The last event is a maximum, summed on the map
    side, so a record with many events is no bottleneck."""
    writing = events.filter(~S.is_gap(F.col("change_type")))
    last = writing.groupBy(*KEY).agg(F.max_by(F.struct("change_type", "fields", "replay_id"), "replay_id").alias("e"))
    rows = last.select(*KEY, "e.*")
    return rows if keep_deleted else rows.filter("change_type <> 'DELETE'").drop("change_type")


def layered(keys: DataFrame, state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """For each key the whole record of the first layer that has it: own state, then the production snapshot."""
    own = state.select(*KEY, F.col("fields").alias("own"))
    production = snapshot.select(*KEY, F.col("fields").alias("production"))
    joined = keys.join(own, KEY, "left").join(production, KEY, "left")
    source = F.when(F.col("own").isNotNull(), "state").when(F.col("production").isNotNull(), "production").otherwise("none")
    return joined.select(*keys.columns, F.coalesce("own", "production").alias("fields"), source.alias("layer"))


def resync(requested: DataFrame, snapshot: DataFrame) -> DataFrame:
    """For requested records (sobject, record_id): upserted with the snapshot's fields, or deleted where it has
    none. Requests go in chunks of 200 by order of id, and an invalid id fails all of its chunk. Ranges of them are
    sorted apart and numbered on from each other, so an object with most of the records is not one task's."""
    from pyspark.sql import Window as W

    placed = graph.numbered(requested.distinct(), F.col("sobject").asc(), F.col("record_id").asc())
    first = placed.groupBy("sobject").agg(F.min("number").alias("_first"))  # a row an object
    chunked = placed.join(first, "sobject").withColumn("chunk", F.floor((F.col("number") - F.col("_first")) / M.CHUNK)).select(*requested.columns, "chunk")
    failed = F.bool_or(~S.is_record_id(F.col("record_id"))).over(W.partitionBy("sobject", "chunk"))
    found = chunked.withColumn("failed", failed).join(snapshot.select(*KEY, "fields"), KEY, "left")
    outcome = F.when(F.col("failed"), "failed").when(F.col("fields").isNull(), "deleted").otherwise("upserted")
    return found.select(*KEY, "chunk", outcome.alias("outcome"), F.when(outcome == "upserted", F.col("fields")).alias("fields"))


def refetch_gaps(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The corrections that gap events call for: their records against the snapshot."""
    return resync(gaps(events).select(*KEY), snapshot)


def corrected(state: DataFrame, corrections: DataFrame) -> DataFrame:
    """The state after corrections (outcome upserted or deleted)."""
    done = corrections.filter("outcome <> 'failed'")
    kept = state.select(*KEY, "fields").join(done.select(*KEY), KEY, "left_anti")
    return kept.unionByName(done.filter("outcome = 'upserted'").select(*KEY, "fields"))


def checkpoint(events: DataFrame, at: str = "processed_at") -> DataFrame:
    """By process: the replay id of the last event that was processed, and when. The last, not the largest."""
    return events.groupBy("process_id").agg(F.max_by("replay_id", F.struct(at, "replay_id")).alias("latest_replay_id"), F.max(at).alias("last_event_at"))


def diff_long(production: DataFrame, runtime: DataFrame, ignored: list[str] = ()) -> DataFrame:
    """Fields that differ as rows (keys, field, production, runtime), from rows (keys, fields). Each side is read
    once and records meet by key."""
    joined = production.select(*KEY, F.col("fields").alias("p")).join(runtime.select(*KEY, F.col("fields").alias("r")), KEY)
    diffs = F.map_entries(S.field_diff(F.col("p"), F.col("r"), list(ignored)))
    return joined.select(*KEY, F.explode(diffs).alias("d")).select(*KEY, F.col("d.key").alias("field"), "d.value.production", "d.value.runtime")


def observe(events: DataFrame, ruled: Column, aborted: Column, reason: Column) -> DataFrame:
    """Events with their category: the fields before the rules against those after (``ruled``), and the trace."""
    no = F.lit(False)
    gap = S.is_gap(F.col("change_type"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<production:string,runtime:string>>"))
    rows = events.withColumn("diffs", F.when(gap, empty).otherwise(S.field_diff(F.col("fields"), ruled)))
    rows = rows.withColumn("c", S.categorise(F.col("change_type"), F.col("sobject"), F.col("diffs"), F.coalesce(aborted, no) & ~gap, reason, no, no, no, F.lit(None).cast("string")))
    return rows.select(*events.columns, "diffs", "c.*")
