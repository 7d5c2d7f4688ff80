"""Operators over the automation corpus.

Components: component_id, category, name, api_name, namespace, and counts of what their documents hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnflow import model as M


def precedence(source: Column) -> Column:
    chain = reduce(lambda w, kv: w.when(source == kv[0], kv[1]), M.PRECEDENCE.items(), F.when(F.lit(False), 0))
    return chain.otherwise(99)


KEY = ["category", "api_name", "namespace"]


def _payload_rows(records: DataFrame) -> DataFrame:
    """A row for each field of each source's record, with the source's rank; the ids group null-safely."""
    return records.select(*KEY, "source", precedence(F.col("source")).alias("rank"), F.explode("payload").alias("field", "value"))


def reconcile(records: DataFrame) -> DataFrame:
    """One row for each component: the payload, each field from the source of highest precedence that has it, and
    the sources in that order. Records: source, category, api_name, namespace, payload map<string,string>."""
    order = F.struct("rank", "source")
    fields = _payload_rows(records).groupBy(*KEY, "field").agg(F.min_by("value", order).alias("value"))
    payload = fields.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("payload"))
    sources = records.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct(precedence(F.col("source")).alias("rank"), "source")))["source"].alias("sources"))
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"p.{k}")) for k in KEY])
    return sources.alias("s").join(payload.alias("p"), same, "left").select(*(f"s.{k}" for k in KEY), F.coalesce("payload", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("payload"), "sources")


def disagreements(records: DataFrame) -> DataFrame:
    """A row for each source whose value of a field differs from the winner's, with all sources' values."""
    field = W.partitionBy(*KEY, "field")
    ranked = _payload_rows(records).withColumn("winner", F.min_by(F.col("value"), F.struct("rank", "source")).over(field))
    ranked = ranked.withColumn("values_by_source", F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "value")).over(field))))
    return ranked.filter(~F.col("value").eqNullSafe(F.col("winner"))).select(*KEY, "field", "source", "value", "winner", "values_by_source")


def coverage(attempts: DataFrame) -> DataFrame:
    """A row for each known category from attempts (category, ok, reason): attempted, succeeded, failed, reasons,
    ratio, which is 1 where nothing was attempted."""
    counts = attempts.groupBy("category").agg(F.count(F.lit(1)).alias("attempted"), F.count_if("ok").alias("succeeded"), F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("reason")))).alias("reasons"))
    every = M.category_table(attempts.sparkSession).select("category")
    n = lambda c: F.coalesce(c, F.lit(0))
    return every.join(counts, "category", "left").select(
        "category", n("attempted").alias("attempted"), n("succeeded").alias("succeeded"), (n("attempted") - n("succeeded")).alias("failed"),
        F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"), F.when(n("attempted") == 0, 1.0).otherwise(F.col("succeeded") / F.greatest(n("attempted"), F.lit(1))).alias("ratio"),
    )


def overall_coverage(report: DataFrame) -> DataFrame:
    total = report.agg(*(F.sum(c).alias(c) for c in ("attempted", "succeeded", "failed")))
    return total.withColumn("ratio", F.when(F.col("attempted") == 0, 1.0).otherwise(F.col("succeeded") / F.col("attempted")))


def suspected_gaps(attempts: DataFrame, include_unseen: bool = False) -> DataFrame:
    """Categories that were looked at and had nothing to attempt: none, as a row is an attempt. With
    ``include_unseen`` the known categories without any row."""
    seen = attempts.select("category").distinct()
    every = M.category_table(attempts.sparkSession).select("category")
    return every.join(seen, "category", "left_anti") if include_unseen else seen.limit(0)


def surface_audit(components: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """A row for each of the 21 steps: structural_count, contributing categories, in_scope, priority.
    ``frequency`` (step, observed) says how often a step was seen to run."""
    spark = components.sparkSession
    used = components.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    steps = M.category_table(spark).select("category", F.explode("steps").alias("step")).join(used, "category")
    counts = steps.groupBy("step").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("category")).alias("contributing"))
    rows = M.step_table(spark).join(counts, "step", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if frequency is not None:
        rows = rows.join(frequency, "step", "left")
    seen = F.col("observed") if frequency is not None else F.lit(None).cast("long")
    out = (F.col("n") == 0) | F.coalesce(seen == 0, F.lit(False))
    priority = F.when(out, "exclude").when(F.coalesce(seen < 5, F.lit(False)), "standard").when(F.col("n") >= 10, "critical").otherwise("standard")
    return rows.select("step", "step_name", F.col("n").alias("structural_count"), F.coalesce("contributing", F.array().cast("array<string>")).alias("contributing"), (~out).alias("in_scope"), priority.alias("priority"))


def framework_signals(classes: DataFrame, record_types: DataFrame) -> DataFrame:
    """framework, confidence, hits from class names (name) and record type names (cmt_type); unknown if none is found."""
    c = classes.distinct().agg(F.coalesce(F.bool_or(F.col("name") == "TriggerHandler"), F.lit(False)).alias("base"), F.count_if(F.endswith("name", F.lit("TriggerHandler"))).alias("handlers"), F.count_if(F.startswith("name", F.lit("fflib_"))).alias("fflib"))
    t = record_types.agg(F.count_if(F.startswith(F.lower("cmt_type"), F.lit("trigger_action"))).alias("actions"))
    signal = lambda name, confidence, hits: F.struct(F.lit(name).alias("framework"), F.lit(confidence).alias("confidence"), hits.cast("long").alias("hits"))
    found = F.array_compact(F.array(
        F.when(F.col("actions") > 0, signal("trigger_actions", 0.95, F.col("actions"))),
        F.when(F.col("base") & (F.col("handlers") >= 2), signal("kevin_ohara", 0.85, F.col("handlers"))),
        F.when(F.col("fflib") >= 3, signal("fflib", 0.8, F.col("fflib"))),
    ))
    one = c.crossJoin(t)  # two tables of one row
    return one.select(F.inline(F.when(F.size(found) > 0, found).otherwise(F.array(signal("unknown", 0.0, F.lit(0))))))


def packages(components: DataFrame) -> DataFrame:
    """By namespace in lower case: adapter kind and name, number of members."""
    ns = F.lower("namespace")
    chain = reduce(lambda w, kv: w.when(F.col("ns") == kv[0], kv[1]), M.PACKAGES.items(), F.when(F.lit(False), ""))
    rows = components.filter(F.coalesce(F.col("namespace"), F.lit("")) != "").groupBy(ns.alias("ns")).agg(F.count(F.lit(1)).alias("members"))
    return rows.select(F.col("ns").alias("namespace"), F.when(chain.isNotNull(), "hand_tuned").otherwise("auto").alias("kind"), F.coalesce(chain, F.col("ns")).alias("adapter"), "members")


def dispatch_edges(records: DataFrame, classes: DataFrame) -> DataFrame:
    """dispatcher, field, handler, confidence: for each field value of the records (developer_name, fields map) the
    class (name) it names: exactly 1.0, but for case 0.9, by what stands before the first underscore 0.6. Of
    several classes that fit, the last in order."""
    values = records.select(F.col("developer_name").alias("dispatcher"), F.explode("fields").alias("field", "value")).filter(F.coalesce(F.col("value"), F.lit("")) != "")
    names = classes.select("name").distinct()
    exact = names.select(F.col("name").alias("value"), F.col("name").alias("exact"))
    folded = names.groupBy(F.lower("name").alias("low")).agg(F.max("name").alias("folded"))
    head = lambda c: F.substring_index(F.lower(c), "_", 1)
    headed = names.groupBy(head(F.col("name")).alias("head")).agg(F.max("name").alias("headed"))
    rows = values.withColumn("low", F.lower("value")).withColumn("head", head(F.col("value")))
    rows = rows.join(exact, "value", "left").join(folded, "low", "left").join(headed, "head", "left")
    confidence = F.when(F.col("exact").isNotNull(), 1.0).when(F.col("folded").isNotNull(), 0.9).when(F.col("headed").isNotNull(), 0.6)
    return rows.select("dispatcher", "field", F.coalesce("exact", "folded", "headed").alias("handler"), confidence.alias("confidence")).filter("handler is not null")


def orphans(classes: DataFrame, bodies: DataFrame) -> DataFrame:
    """Classes (name) that no trigger body names. Names are looked up among the bodies' words, so the bodies are
    read once and meet the classes by equality; a name that stands inside a longer word does not count."""
    words = bodies.select(F.explode(F.array_distinct(F.split("body", r"[^A-Za-z0-9_]+"))).alias("name")).filter("name <> ''")
    return classes.join(words.distinct(), "name", "left_anti")


def orphans_contained(classes: DataFrame, bodies: DataFrame) -> DataFrame:
    """``orphans`` with any occurrence counting. A body's stretches of the names' lengths meet the names by equality,
    so no side is broadcast; a name of word characters only is sought in the distinct words of all bodies, each once."""
    lengths = classes.select(F.length("name").alias("_n")).filter("_n is not null").distinct().agg(F.collect_set("_n")).scalar()
    plain = F.coalesce(F.col("name").rlike("^[A-Za-z0-9_]+$"), F.lit(False))

    def stretches(texts: DataFrame) -> DataFrame:
        sized = texts.select("text", F.explode(lengths).alias("_n")).filter(F.length("text") >= F.col("_n"))
        return sized.select("text", "_n", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("_n") + 1)).alias("_at")).select(F.substring("text", F.col("_at"), F.col("_n")).alias("name")).distinct()

    words = bodies.select(F.explode(F.array_distinct(F.split("body", r"[^A-Za-z0-9_]+"))).alias("text")).distinct()
    found = classes.filter(plain).join(stretches(words), "name", "left_anti")
    return found.unionByName(classes.filter(~plain).join(stretches(bodies.select(F.col("body").alias("text"))), "name", "left_anti"))


#: Channels in the order in which they are asked, with their confidence.
CHANNELS = [("runtime_log", 0.99), ("lwc_import", 0.9), ("named_credential", 0.8), ("connected_app_scope", 0.7), ("cron_trigger", 0.85), ("integration_doc", 0.75)]


def resolve_orphans(orphan_classes: DataFrame, sightings: DataFrame) -> DataFrame:
    """name, channel, confidence, evidence of each class, by the first channel that has a sighting of it
    (channel, name, evidence); null where none has. Several pieces of evidence are joined in order."""
    rank = reduce(lambda w, kv: w.when(F.col("channel") == kv[1][0], kv[0]), enumerate(CHANNELS), F.when(F.lit(False), 0))
    confidence = reduce(lambda w, c: w.when(F.col("channel") == c[0], c[1]), CHANNELS, F.when(F.lit(False), 0.0))
    seen = sightings.groupBy("name", "channel").agg(F.array_join(F.array_sort(F.collect_set("evidence")), ", ").alias("evidence"))
    best = seen.withColumn("rank", rank).filter("rank is not null").groupBy("name").agg(F.min_by(F.struct("channel", "evidence"), "rank").alias("b"))
    return orphan_classes.join(best, "name", "left").select("name", F.col("b.channel").alias("channel"), "b.evidence").withColumn("confidence", confidence)


def lookup_defaults(components: DataFrame, scores: DataFrame, annotations: DataFrame) -> DataFrame:
    """Components with their scores and annotations, or 50/50, tier 1 and "other" where there are none."""
    joined = components.join(scores.select("component_id", "difficulty", "risk"), "component_id", "left").join(annotations.select("component_id", "domain", "recommended_tier"), "component_id", "left")
    return joined.select("component_id", "name", F.coalesce("difficulty", F.lit(50)).alias("difficulty"), F.coalesce("risk", F.lit(50)).alias("risk"), F.coalesce("domain", F.lit("other")).alias("domain"), F.coalesce("recommended_tier", F.lit("tier1_rules")).alias("tier"))


def complexity(components: DataFrame) -> DataFrame:
    """component_id, difficulty, risk, drivers: the category's baseline and what its document adds, within 0 to 100.

    Reads counts: decisions, dml, subflows, screens, body_lines, n_events, classification, n_imports, formula.
    Absent counts are null and add nothing."""
    base = M.category_table(components.sparkSession).select("category", F.col("difficulty").alias("d0"), F.col("risk").alias("r0"))
    rows = components.join(F.broadcast(base), "category")  # 21 rows
    cat, n = F.col("category"), lambda c: F.coalesce(F.col(c), F.lit(0))
    flow = F.endswith(cat, F.lit("_flow")) | (cat == "process_builder")
    text = F.coalesce("formula", F.lit(""))
    say = lambda x, after: F.concat(x.cast("string"), F.lit(after))
    cross = text.rlike(r"^[^.]*[A-Z][^.]*\.")
    rules = [  # condition, difficulty, risk, driver
        (flow & (n("decisions") >= 20), 20, 0, say(n("decisions"), " decision nodes (>=20)")),
        (flow & n("decisions").between(8, 19), 8, 0, say(n("decisions"), " decision nodes")),
        (flow & (n("dml") >= 5), 10, 10, say(n("dml"), " DML operations")),
        (flow & (n("subflows") > 0), F.least(n("subflows"), F.lit(4)) * 5, 0, say(n("subflows"), " subflow references")),
        ((cat == "screen_flow") & (n("screens") > 0), 0, -5, F.lit(None).cast("string")),
        ((cat == "apex_trigger") & (n("body_lines") >= 200), 20, 0, say(n("body_lines"), "-line trigger body")),
        ((cat == "apex_trigger") & (n("n_events") >= 3), 10, 0, say(n("n_events"), " trigger events")),
        ((cat == "lwc_bundle") & (F.col("classification") == "business_logic_heavy"), 25, 0, F.lit("business-logic-heavy LWC")),
        ((cat == "lwc_bundle") & (F.col("classification") == "mixed"), 10, 0, F.lit("mixed LWC")),
        ((cat == "lwc_bundle") & (n("n_imports") >= 3), 5, 0, say(n("n_imports"), " Apex imports")),
        ((cat == "validation_rule") & (F.length(text) > 200), 15, 10, say(F.length(text), "-char formula")),
        ((cat == "formula_field") & cross, 10, 0, F.lit("cross-object reference in formula")),
        ((cat == "formula_field") & (F.length(text) > 300), 15, 0, say(F.length(text), "-char formula")),
    ]
    add = lambda k: reduce(lambda a, r: a + F.when(r[0], r[k]).otherwise(0), rules, F.lit(0))
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(100), x)).cast("int")
    drivers = F.array_compact(F.array(F.concat(F.lit("baseline for "), cat), *(F.when(r[0], r[3]) for r in rules)))
    return rows.select("component_id", "category", "name", clamp(F.col("d0") + add(1)).alias("difficulty"), clamp(F.col("r0") + add(2)).alias("risk"), drivers.alias("drivers"))


def heatmap(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.col("difficulty").desc(), F.col("risk").desc(), "name", "component_id")


def classify_tier(components: DataFrame) -> DataFrame:
    """component_id, tier, confidence: the category's default, moved by calls, branching or screens."""
    base = M.category_table(components.sparkSession).select("category", "tier")
    rows = components.join(F.broadcast(base), "category", "left").withColumn("tier", F.coalesce("tier", F.lit("tier1_rules")))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    place = lambda tier, confidence: F.struct(tier.alias("tier"), F.lit(confidence).alias("confidence"))
    durable = ((n("callouts") > 0) | (n("subflows") > 0)) & (F.col("tier") == "tier1_rules")
    talk = (n("screens") > 0) | F.coalesce(F.col("classification") == "business_logic_heavy", F.lit(False))
    found = F.when(durable, place(F.lit("tier2_temporal"), 0.85)).when(n("decisions") >= 20, place(F.lit("tier3_langgraph"), 0.7)).when(talk, place(F.lit("tier3_langgraph"), 0.75)).otherwise(place(F.col("tier"), 0.9))
    return rows.select("component_id", "category", found.alias("t")).select("component_id", "category", "t.tier", "t.confidence", F.col("category").isin(M.DUAL_TARGET).alias("dual_target"))


def manifest_counts(tiers: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    counts = tiers.agg(*(F.count_if(F.col("tier") == t).alias(a) for t, a in (("tier1_rules", "tier1"), ("tier2_temporal", "tier2"), ("tier3_langgraph", "tier3"))), F.count_if("dual_target").alias("dual"))
    return counts if skipped is None else counts.crossJoin(skipped.agg(F.count(F.lit(1)).alias("skipped")))


def script_signals(scripts: DataFrame, text: str = "source") -> DataFrame:
    """Counts of what a script does, its imports, score and class."""
    x = F.col(text)
    counts = {n: F.regexp_count(x, F.lit(p)) for n, p in M.SCRIPT_SIGNALS.items()}
    rows = scripts.select(*(c for c in scripts.columns if c != text), *(c.alias(n) for n, c in counts.items()), (F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) + 1).alias("lines"), F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(M.SCRIPT_IMPORT), F.lit(1)))).alias("imports"))
    score = F.col("imperative_calls") * 3 + F.col("wire_calls") + F.col("conditionals") + F.col("fetch_calls")
    kind = F.when((score == 0) & (F.col("lines") < 50), "ui_only").when((score >= 8) | (F.col("lines") >= 200), "business_logic_heavy").otherwise("mixed")
    return rows.withColumn("score", score).withColumn("classification", kind)


def bundle_class(files: DataFrame, by: str) -> DataFrame:
    """The worst class of a bundle's scripts, and all their imports."""
    order = {"ui_only": 0, "mixed": 1, "business_logic_heavy": 2}
    rank = reduce(lambda w, kv: w.when(F.col("classification") == kv[0], kv[1]), order.items(), F.when(F.lit(False), 0))
    return files.groupBy(by).agg(F.max_by("classification", rank).alias("classification"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("imports")))).alias("imports"))


def trigger_header(body: Column) -> Column:
    """struct<name, object, timing, events> of a trigger's head; null if it has none."""
    part = lambda k: F.regexp_extract(body, M.TRIGGER_HEADER, k)
    events = F.transform(F.split(part(4), ","), lambda e: F.lower(F.trim(e)))
    return F.when(part(1) != "", F.struct(part(1).alias("name"), part(2).alias("object"), F.lower(part(3)).alias("timing"), events.alias("events")))


def annotations(replies: DataFrame, domains: list[str], text: str = "reply") -> DataFrame:
    """Annotations read from free-text replies, with defaults for what is missing or not allowed."""
    from cairnflow.functions.scalar import json_in_text

    schema = "summary string, domain string, complexity_band string, recommended_tier string, confidence double"
    parsed = replies.withColumn("_a", F.from_json(json_in_text(F.col(text)), schema))
    allowed = lambda c, values, default: F.when(F.col(f"_a.{c}").isin(values), F.col(f"_a.{c}")).otherwise(default).alias(c)
    tiers = [t for t in ("tier1_rules", "tier2_temporal", "tier3_langgraph")]
    return parsed.select(
        *(c for c in replies.columns if c != text), F.substring(F.coalesce("_a.summary", F.lit("")), 1, 300).alias("summary"), allowed("domain", domains, "other"),
        allowed("complexity_band", ["low", "medium", "high"], "medium"), allowed("recommended_tier", tiers, tiers[0]), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_a.confidence", F.lit(0.5)))).alias("confidence"),
    )
