"""Change events from files of JSON lines, as a batch or a stream, and a maker of such files."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow import model as M


def _topics(events: DataFrame, topics: list[str] | None) -> DataFrame:
    from cairnflow.operators.cdc import subscribed

    return subscribed(events, list(topics or []))


def read(spark: SparkSession, folder: str, topics: list[str] | None = None) -> DataFrame:
    return _topics(spark.read.schema(M.CDC_SCHEMA).json(folder), topics)


def read_stream(spark: SparkSession, folder: str, topics: list[str] | None = None, files_per_batch: int = 25) -> DataFrame:
    """The same as a stream; it ends with what is there if started with ``trigger(availableNow=True)``."""
    stream = spark.readStream.schema(M.CDC_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return _topics(stream, topics)


class Recorder:
    """Collects synthetic events with rising replay ids of 20 digits and writes them as a file of JSON lines.

    A registered entity has a set of fields; an event carries all of them, absent ones as null, and a gap carries
    nothing but nulls."""

    def __init__(self) -> None:
        self.schemas: dict[str, list[str]] = {}
        self.events: list[dict] = []

    def register(self, entity: str, fields: Iterable[str]) -> None:
        self.schemas[entity] = list(fields)

    def add(self, change_type: str, entity: str, record_id: str, at: str, **fields: str | None) -> str:
        if entity not in self.schemas:
            raise KeyError(f"{entity} is not registered")
        if unknown := set(fields) - set(self.schemas[entity]):
            raise ValueError(f"{entity} has no {sorted(unknown)}")
        gap = change_type.startswith("GAP_")
        replay_id = f"{len(self.events) + 1:020d}"
        values = {f: None if gap else fields.get(f) for f in self.schemas[entity]}
        self.events.append({"replay_id": replay_id, "sobject": entity, "record_id": record_id, "change_type": change_type, "commit_ts": at, "fields": values})
        return replay_id

    def write(self, folder: str, name: str = "events.json") -> None:
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, name), "w", encoding="utf-8") as out:
            out.writelines(json.dumps(e) + "\n" for e in self.events)


def schema_id(entity: str, fields: dict[str, str]) -> str:
    """A stable id of an entity's schema: the head of a hash of its sorted form."""
    import hashlib

    text = json.dumps({"entity": entity, "fields": dict(sorted(fields.items()))}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def decode(rows: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """Payloads of a registered schema, a DDL text, as columns."""
    return rows.withColumn("fields", F.from_json(payload, schema))
