"""Small column functions of the domain."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnflow import model as M


def matches(x: Column, pattern: str, longest: int | None = None) -> Column:
    """Whether a text matches a validator; null does not."""
    ok = x.rlike(pattern) if longest is None else x.rlike(pattern) & (F.length(x) <= longest)
    return F.coalesce(ok, F.lit(False))


def is_identifier(x: Column) -> Column:
    return matches(x, M.IDENTIFIER, 80)


def is_record_id(x: Column) -> Column:
    return matches(x, M.RECORD_ID)


def is_field_path(x: Column) -> Column:
    return matches(x, M.FIELD_PATH, 255)


def in_list(ids: Column) -> Column:
    """A quoted, comma-joined list of 1 to 200 valid record ids; null if any is invalid or there are too many."""
    ok = F.size(ids).between(1, M.CHUNK) & F.forall(ids, is_record_id)
    return F.when(ok, F.array_join(F.transform(ids, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ","))


def safe_identifier(x: Column) -> Column:
    """Letters, digits and underscores only; a leading digit gets an underscore in front."""
    plain = F.regexp_replace(x, r"[^0-9A-Za-z_]", "_")
    return F.when(plain.rlike(r"^[0-9]"), F.concat(F.lit("_"), plain)).otherwise(plain)


def band(score: Column) -> Column:
    return F.when(score < 35, "b-low").when(score < 70, "b-med").otherwise("b-high")


def tier_class(tier: Column) -> Column:
    return F.when(tier == "tier1_rules", "b-tier1").when(tier == "tier2_temporal", "b-tier2").when(tier == "tier3_langgraph", "b-tier3").otherwise("b-med")


def looks_numeric(x: Column) -> Column:
    """Digits with at most one point, behind any number of minus signs; null does not."""
    return F.coalesce(F.regexp_replace(x, r"^([^.]*)\.", "$1").rlike(r"\A-*[0-9]+\z"), F.lit(False))


def is_gap(change_type: Column) -> Column:
    return F.coalesce(F.startswith(change_type, F.lit("GAP_")), F.lit(False))


def json_in_text(x: Column) -> Column:
    """The JSON object in a reply: in a fence, or else from the first brace to the last; null if there is none."""
    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(bare != "", bare)


def bucket_md5(key: Column) -> Column:
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % 100).cast("int")


@F.pandas_udf(T.IntegerType())
def bucket_blake2b(key: pd.Series) -> pd.Series:
    """The first 8 bytes of BLAKE2b, big-endian, modulo 100. No built-in function computes this hash."""
    return key.map(lambda k: None if k is None else int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "big") % 100)


def routing_key(seed: Column, process: Column, record: Column) -> Column:
    return F.concat_ws(":", seed, process, record)


def _chain(pairs: list[tuple[int, object]], x: Column, default) -> Column:
    chain = reduce(lambda w, p: w.when(x == p[0], p[1]), pairs, F.when(F.lit(False), pairs[0][1]))
    return chain.otherwise(default)


def next_stage(percent: Column) -> Column:
    """The next percent; 1 from an unknown one, null from the last."""
    stages = [p for p, _ in M.STAGES]
    return _chain(list(zip(stages, [*stages[1:], F.lit(None).cast("int")])), percent, 1)


def previous_stage(percent: Column) -> Column:
    stages = [p for p, _ in M.STAGES]
    return _chain(list(zip(stages, [0, *stages[:-1]])), percent, 0)


def dwell_hours(percent: Column) -> Column:
    return _chain(M.STAGES, percent, 0)


def dwell_remaining_s(percent: Column, entered: Column, now: Column) -> Column:
    """Seconds until the stage has lasted long enough."""
    passed = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(entered.cast("timestamp"))) / F.lit(1e6)
    return F.greatest(dwell_hours(percent) * F.lit(3600.0) - passed, F.lit(0.0))


def tidy(x: Column) -> Column:
    """For comparing: the empty text is no value."""
    return F.when(x != "", x)


def field_diff(production: Column, runtime: Column, ignored: list[str] = ()) -> Column:
    """map<field, struct<production, runtime>> of the fields that differ; absent, null and empty are the same."""
    both = F.map_zip_with(production, runtime, lambda k, a, b: F.struct(a.alias("production"), b.alias("runtime")))
    skip = F.array(*map(F.lit, ignored)).cast("array<string>")
    return F.map_filter(both, lambda k, v: ~tidy(v["production"]).eqNullSafe(tidy(v["runtime"])) & ~F.array_contains(skip, k))


def categorise(change_type: Column, entity: Column, diffs: Column, aborted: Column, reason: Column, ordering: Column, governor: Column, artifact: Column, artifact_reason: Column) -> Column:
    """struct<diverged, category, severity, explanation> of an event, by the first rule that applies."""
    fields = F.concat(F.lit("['"), F.array_join(F.array_sort(F.map_keys(diffs)), "', '"), F.lit("']"))
    numeric = (F.size(diffs) > 0) & F.forall(F.map_values(diffs), lambda v: looks_numeric(v["production"]) | looks_numeric(v["runtime"]))
    why = F.coalesce(reason, F.lit(""))
    cases = [
        (is_gap(change_type), "gap_event_full_refetch_required", 80, F.concat(F.lit("gap event ("), change_type, F.lit(") on "), entity, F.lit(": re-fetch"))),
        ((F.size(diffs) == 0) & ~aborted, None, 0, F.lit("no divergence")),
        (aborted & F.contains(why, F.lit("MixedDML")), "ooe_ordering_mismatch", 60, F.concat(F.lit("aborted with mixed objects: "), why)),
        (aborted & F.contains(why, F.lit("Cascade")), "ooe_ordering_mismatch", 70, F.concat(F.lit("cascade depth exceeded: "), why)),
        (aborted & F.contains(F.lower(why), F.lit("validation")), "translation_error", 50, F.concat(F.lit("validation fired where production accepted: "), why)),
        (numeric, "formula_edge_case", 40, F.concat(F.lit("numeric divergence on "), fields)),
        (ordering, "non_deterministic_trigger_ordering", 55, F.lit("triggers fired in differing orders")),
        (governor, "governor_limit_behavior", 35, F.lit("logic ran that limits would have skipped")),
        (artifact, "test_environment_artifact", 10, F.coalesce(artifact_reason, F.lit("test environment difference"))),
    ]
    result = lambda category, severity, text: F.struct(
        F.lit(category is not None).alias("diverged"), F.lit(category).cast("string").alias("category"), F.lit(severity).alias("severity"), text.alias("explanation")
    )
    chain = reduce(lambda w, c: w.when(c[0], result(*c[1:])), cases[1:], F.when(cases[0][0], result(*cases[0][1:])))
    return chain.otherwise(result("translation_error", 50, F.concat(F.lit("field-level divergence on "), fields)))


def register(spark) -> None:
    """The helpers that have no built-in counterpart, for SQL."""
    spark.udf.register("bucket_blake2b", bucket_blake2b)
