"""Documents made of small results: JSON and HTML reports, logs and provenance.

What a report collects is an aggregate or a top-k; tables are written as tables.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.functions.scalar import band, tier_class
from cairnflow.operators import corpus, readiness


def _rows(df: DataFrame, most: int) -> list[dict]:
    return [json.loads(x) for (x,) in df.limit(most).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()]


def table_html(rows: list[dict]) -> str:
    if not rows:
        return "<p>none</p>"
    head = "".join(f"<th>{html.escape(str(c))}</th>" for c in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def page(title: str, **sections: list[dict]) -> str:
    parts = "".join(f"<h2>{html.escape(n.replace('_', ' '))}</h2>{table_html(r)}" for n, r in sections.items())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{parts}</body></html>"


def corpus_report(components: DataFrame, attempts: DataFrame, most: int = 10_000) -> dict:
    """Heat map, coverage, steps and packages of a corpus."""
    scores = corpus.complexity(components)
    tiers = corpus.classify_tier(components).select("component_id", "tier", tier_class(F.col("tier")).alias("tier_class"))
    shown = corpus.heatmap(scores.join(tiers, "component_id")).withColumn("band", band(F.col("difficulty")))
    return {
        "schema_version": "1.0", "components": _rows(shown, most), "coverage": _rows(corpus.coverage(attempts).filter("attempted > 0").orderBy("category"), 100),
        "steps": _rows(corpus.surface_audit(components).orderBy("step"), 100), "packages": _rows(corpus.packages(components).orderBy("namespace"), most),
    }


def shadow_dashboard(observations: DataFrame, now: str) -> dict:
    """The 200 newest divergences and the processes' scores, lowest first, with ok from 98 and warn from 90."""
    scores = readiness.readiness(readiness.in_window(observations, now))
    state = F.when(F.col("score") >= 98, "ok").when(F.col("score") >= 90, "warn").otherwise("bad")
    recent = readiness.newest(observations.filter("diverged"), 200, "observed_at", "id")
    return {"scores": _rows(scores.withColumn("state", state).orderBy("score", "process_id"), 10_000), "recent": _rows(recent, 200)}


def compliance(observations: DataFrame, process_id: str, now: str) -> dict:
    """A process's newest divergences, 10,000 at most, with its score and lag."""
    own = observations.filter(F.col("process_id") == process_id)
    return {
        "process_id": process_id, "generated_at": now, "score": _rows(readiness.readiness(readiness.in_window(own, now)), 1), "lag": _rows(readiness.lag(own, now), 1),
        "divergences": _rows(readiness.newest(own.filter("diverged"), 10_000, "observed_at", "id"), 10_000),
    }


def parity(findings: DataFrame) -> dict:
    counts = _rows(readiness.parity_counts(findings).orderBy("dimension", "value"), 1_000)
    grouped = _rows(findings.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("severity")).alias("severities")).orderBy("category"), 100)
    return {"counts": counts, "by_category": grouped}


def provenance(events: DataFrame, component: str, body: str = "payload") -> DataFrame:
    """An append log: anchor_id, content_hash, component, payload; look-ups are filters."""
    hashed = F.sha2(F.col(body), 256)
    return events.select(F.concat(F.lit("anchor:"), F.substring(hashed, 1, 12), F.lit(":"), F.xxhash64(body).cast("string")).alias("anchor_id"), hashed.alias("content_hash"), F.lit(component).alias("component"), F.col(body).alias("payload"))


def write_extract(folder: str, **tables: DataFrame) -> None:
    """Each table as JSON lines in a folder of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def upsert(path: str, rows: DataFrame, keys: list[str], new_path: str) -> None:
    """A table with rows added or replaced by key, written as a new version: readers of the old one are not hurt."""
    old = rows.sparkSession.read.parquet(path)
    old.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows).write.parquet(new_path)
