"""Information-theoretic sanitisation of personal data, in DataFrame functions alone.

Personal data of four kinds is found by pattern; each distinct value is a protected entity. Removing the value
is not enough where other words give it away, so the corpus is asked how much they do. Distinct lines are the
events: with N of them, ``p(x)`` the share of them that hold x, and ``p(c, t)`` the share that hold entity c with
term t in the line or next to it, or (if fewer) t with c in the line or next to it, t reveals c to the degree

    PMI(c; t) / IC(c) = log(p(c, t) / (p(c) p(t))) / -log p(c)

which is 1 if t occurs with c alone, and 0 if they are independent. Every entity is judged with every term around
it; a degree counts if so many common lines are no chance. Terms of at least ``remove`` are removed, those of at
least ``generalise`` are replaced by a general word, everywhere in the corpus.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.scratch import scratch_table

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("term_removed", "term_generalised")
#: What stands in a sanitised text for a span of each kind.
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term_removed": "", "term_generalised": "[TERM]"}

# Patterns as the contract gives them, with possessive repeats where nothing can be given back (the engine then
# loops instead of recursing) and with starts inside a run left out where an earlier start would have matched:
# only the run's first place, or the end of the last match (\G), can start one. That keeps long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has none of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
SPAN = "struct<kind:string,start:bigint,end:bigint,value:string>"
#: Private signs around a name that stands for a value.
NAME = "\ue000\ue001"
NO_LETTERS = r"[^\p{L}]++"
#: Spans of a block.
BLOCK = 128


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.substring(x, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def fold(text: Column) -> Column:
    """Lower case, one code point for one: the dotted capital I is the only one whose lower case is longer."""
    return F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column) -> Column:
    """An array in blocks of ``BLOCK``. To append to an accumulator copies it, so results gather by block: time
    then grows as the length times ``BLOCK``, and with the square of the number of blocks only."""
    last = F.greatest(F.ceil(F.size(items) / BLOCK).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))


def pattern_spans(text: Column, kind: str, pattern: Column | str) -> Column:
    """Leftmost non-overlapping matches as an array of (kind, start, end, value), in code points, end exclusive.

    The parts between the matches tell where they are: a match starts after all parts and matches before it.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    value = F.regexp_extract_all(text, pattern, F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), value.alias("value"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    span = lambda a, b, v: F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), v.alias("value"))

    def step(acc, x):
        at = acc["at"] + F.length(x["gap"])
        end = at + F.length(x["value"])
        return F.struct(F.coalesce(end, at).alias("at"), F.when(x["value"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span(at, end, x["value"])))).alias("spans"))

    def joined(parts):
        begin = F.aggregate(parts, F.array(zero), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["at"])))
        moved = lambda p, at: F.transform(p["spans"], lambda x: span(x["start"] + at, x["end"] + at, x["value"]))
        return F.flatten(F.zip_with(parts, F.slice(begin, F.lit(1), F.size(parts)), moved))

    return _let(zipped, lambda z: _let(F.transform(_blocks(z), lambda items: F.aggregate(items, start, step)), joined))


def base_spans(text: Column) -> dict[str, Column]:
    """By kind, the spans that pass its test; failing matches are dropped, not retried."""
    none = F.array().cast(f"array<{SPAN}>")
    found = {}
    for kind in KINDS:
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
        valid = partial(_valid, kind)
        found[kind] = F.when(hint, F.filter(pattern_spans(text, kind, PATTERNS[kind]), lambda x: valid(x["value"]))).otherwise(none)  # noqa: B023
    return found


def _order(spans: Column, kinds: tuple[str, ...]) -> Column:
    rank = lambda x: reduce(lambda w, k: w.when(x["kind"] == kinds[k], k), range(1, len(kinds)), F.when(x["kind"] == kinds[0], 0))
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("a"), rank(x).alias("b"), x["end"].alias("c"), x.alias("span")))
    return F.transform(F.array_sort(keyed), lambda x: x["span"])


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _lines(rows: DataFrame, *also: str) -> DataFrame:
    return rows.select(*also, F.explode(F.split("text", r"\n")).alias("line")).withColumn("line_id", F.xxhash64("line"))


def _terms(line: Column) -> Column:
    """A line's distinct words of letters, at least three long, in lower case."""
    return F.array_distinct(F.filter(F.split(fold(line), NO_LETTERS), lambda w: F.length(w) >= 3))


def _hits(rows: DataFrame, *also: str) -> DataFrame:
    """Every word of at least three letters of ``line``, repeats included: rows of ``also`` and term."""
    return rows.select(*also, F.explode(F.split(fold(F.col("line")), NO_LETTERS)).alias("term")).filter(F.length("term") >= 3)


def entity_lines(entities: DataFrame) -> DataFrame:
    """line_id, terms, names, and both of the line and its neighbours, of the distinct lines in or next to which
    entities stand. Every value is written into the text as a name between two private signs, so that a line's names
    and the words around them are found in one walk."""
    plain = F.replace(F.replace(F.col("text"), F.lit(NAME[0]), F.lit(" ")), F.lit(NAME[1]), F.lit(" "))
    tagged = _replaced(plain, F.col("base"), lambda x, at: F.concat(F.lit(NAME[0]), x["kind"], F.lit(":"), x["value"], F.lit(NAME[1])))
    name = f"{NAME[0]}([^{NAME[1]}]*+){NAME[1]}"
    names = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(name), F.lit(1)))
    terms = lambda x: _terms(F.regexp_replace(x, name, " "))
    rows = entities.select(F.split("text", r"\n").alias("line"), F.split(tagged, r"\n").alias("tagged"))
    rows = rows.select("line", F.transform("tagged", terms).alias("terms"), F.transform("tagged", names).alias("names"))
    none, n = F.array(F.array().cast("array<string>")), F.size("line")
    sides = [x for c in ("terms", "names") for x in (F.concat(none, F.slice(c, 1, n - 1)).alias(f"{c}_before"), F.concat(F.slice(c, 2, n), none).alias(f"{c}_after"))]
    lines = rows.select(F.explode(F.arrays_zip("line", "terms", "names", *sides)).alias("x"))
    near = [F.array_distinct(F.concat(f"x.{c}", f"x.{c}_before", f"x.{c}_after")).alias(f"{c}_near") for c in ("terms", "names")]
    return lines.select(F.xxhash64("x.line").alias("line_id"), "x.terms", "x.names", *near).filter(F.size("names_near") > 0).distinct()


def judged_pairs(held: DataFrame, of_entity: DataFrame) -> DataFrame:
    """entity, n_c, term, n_ct: each entity of ``of_entity`` with every term in or next to its lines, counted by
    distinct lines of ``held``."""

    def shared(names: str, terms: str, n: str) -> DataFrame:
        each = held.select("line_id", F.explode(names).alias("entity"), terms).join(of_entity.select("entity"), "entity")
        return each.select("line_id", "entity", F.explode(terms).alias("term")).distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias(n))

    pairs = shared("names", "terms_near", "n1").join(shared("names_near", "terms", "n2"), ["entity", "term"])
    return pairs.join(of_entity, "entity").select("entity", "n_c", "term", F.least("n1", "n2").alias("n_ct"))


def _surprise(n: Column, n_c: Column, n_ct: Column, n_t: Column) -> Column:
    """Minus the log of Chernoff's bound on the chance that ``n_ct`` or more of ``n_c`` lines meet ``n_t`` of ``n``."""
    apart, missing = n_c - n_ct, n - n_t
    rest = F.when((apart > 0) & (missing > 0), apart * F.log(apart * n / (n_c * missing))).otherwise(0.0)
    return F.when(n_ct * n > n_c * n_t, n_ct * F.log(n_ct * n / (n_c * n_t)) + rest).otherwise(0.0)


def revealing_terms(texts: DataFrame, entities: DataFrame, support: int, generalise: float, remove: float, most_broadcast: int, chance: float = 0.05) -> DataFrame:
    """term, degree (the largest over the entities it goes with beyond chance), kind: the terms that reveal an entity.

    ``texts``: text of all rows; ``entities``: text and base of those with personal data. ``chance`` bounds the
    probability that any of the pairs passes by accident (Bonferroni). Terms that no count could make pass are left
    out of the count, first by the entity's own lines, then by 512 bits a term, of which each one set is a line more.
    """
    held = scratch_table(entity_lines(entities), "entity_lines")
    met = held.select("line_id", F.size("terms_near").alias("t"), F.explode("names").alias("entity"))
    met = met.groupBy("entity", "line_id").agg(F.count(F.lit(1)).alias("k"), F.max("t").alias("t"))
    met = scratch_table(met.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"), F.sum("k").alias("k"), F.max("t").alias("t")), "entities")
    pairs = scratch_table(judged_pairs(held, met.filter("k > 1").select("entity", "n_c")).filter(F.col("n_ct") >= support), "pairs")
    # an entity in one line, between the same neighbours: its pairs, all with a count of one, need no list to be counted
    once = met.filter("k = 1").agg(F.sum("t")).first()[0] or 0 if support <= 1 else 0
    m = pairs.count() + once
    none = pairs.select("term", F.lit(0.0).alias("degree"), F.lit("").alias("kind")).limit(0)
    if not m:
        return none
    n = float(_lines(texts).select("line_id").distinct().count())
    # a term is met in its line and next to it: so many lines for each of its own
    size = F.size(F.split("text", r"\n"))
    reach = F.lit(more := texts.agg(F.sum(3 * size - 2) / F.sum(size)).first()[0])
    if once and max(n, 2.0) / more >= m / chance * (1 - 1e-9):  # else chance alone explains any count of one
        pairs = scratch_table(pairs.unionByName(judged_pairs(held, met.filter("k = 1").select("entity", "n_c"))), "all_pairs")
    total, least = F.greatest(F.lit(n), F.col("n_c") + 1.0), F.log(F.lit(m / chance))
    possible = pairs.filter(_surprise(total, F.col("n_c"), F.col("n_ct"), F.col("n_ct") * reach) >= least)
    upto = F.col("n_ct") * F.pow(total / F.col("n_c"), F.lit(1.0 - generalise)) * (1 + 1e-6)
    wanted = scratch_table(possible.groupBy("term").agg(F.max(upto).alias("upto")), "terms")
    small = F.broadcast(wanted) if wanted.count() <= most_broadcast else wanted
    held = _hits(_lines(texts), "line_id")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright("line_id", 3), F.lit(64)).cast("int"))
    words = [F.bit_or(F.when(F.pmod("line_id", F.lit(8)) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(8)]
    seen = held.join(small.select("term"), "term").groupBy("term").agg(*words)
    at_least = reduce(lambda x, y: x + y, (F.bit_count(f"b{k}") for k in range(8)))
    rare = scratch_table(seen.select("term", at_least.alias("n")).join(wanted, "term").filter("n <= upto").select("term"), "rare_terms")
    n_rare = rare.count()
    if not n_rare:
        return none
    few = F.broadcast(rare) if n_rare <= most_broadcast else rare
    of_term = held.join(few, "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    counted = possible.join(of_term, "term").withColumn("n_t", F.greatest("n_t", "n_ct"))
    sure = counted.filter(_surprise(total, F.col("n_c"), F.col("n_ct"), F.col("n_t") * reach) >= least)
    pmi = F.log(F.col("n_ct") * total / (F.col("n_c").cast("double") * F.col("n_t")))
    degrees = sure.groupBy("term").agg(F.max(pmi / F.log(total / F.col("n_c"))).alias("degree"))
    kind = F.when(F.col("degree") >= remove - 1e-9, TERM_KINDS[0]).when(F.col("degree") >= generalise, TERM_KINDS[1])
    return degrees.withColumn("kind", kind).filter("kind is not null")


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 1, generalise: float = 0.9, remove: float = 1.0, most_broadcast: int = 200_000) -> DataFrame:
    """row (all columns of ``docs``), doc_id, text (null: empty), base, spans (base and terms in order) of each row.

    ``docs`` is read several times and never shuffled; texts meet their terms by a table of those that hold any.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.withColumn("base", _order(F.concat(*base_spans(F.col("text")).values()), KINDS))
    # rows with personal data are a small part of a corpus, and their texts are needed once more
    with_data = scratch_table(found.select("text", "base").filter(F.size("base") > 0), "with_data")
    texts = rows.select("text")
    terms = scratch_table(revealing_terms(texts, with_data, support, generalise, remove, most_broadcast), "disclosing")
    n = terms.count()
    if not n:
        return found.withColumn("spans", F.col("base"))
    small = F.broadcast(terms) if n <= most_broadcast else terms
    words = _hits(texts.select(F.xxhash64("text").alias("text_id"), F.col("text").alias("line")), "text_id").join(small.select("term", "kind"), "term")
    per_row = [F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("term")))).alias(k) for k in TERM_KINDS]
    of_text = scratch_table(words.groupBy("text_id").agg(*per_row), "terms_of_text")
    joined = found.withColumn("text_id", F.xxhash64("text")).join(of_text, "text_id", "left")
    return joined.withColumn("spans", _with_terms()).select("row", "doc_id", "text", "base", "spans")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, text, base, spans (base and terms in order) of each row of ``docs``, whole texts.

    Null texts are empty and have no spans. Repeated rows give repeated results. An empty table gives an empty
    result, other columns are not read. Tables of terms are broadcast up to ``most_broadcast`` terms and joined by
    shuffle beyond. ``support`` above 1 leaves out pairs that share fewer lines.
    """
    return with_spans(docs.select(id_col, text_col), id_col, text_col, **options).drop("row")


def _with_terms() -> Column:
    """The spans of base and, in what they leave of the text, of the terms."""
    none = F.array().cast(f"array<{SPAN}>")
    left = blanked(F.col("text"), F.col("base"))
    more = []
    for kind in TERM_KINDS:
        listed = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(kind, "|"), F.lit(r")(?!\p{L})"))
        more.append(F.when(F.size(kind) > 0, pattern_spans(fold(left), kind, listed)).otherwise(none))
    return _order(F.concat("base", *more), KINDS + TERM_KINDS)


def _replaced(text: Column, spans: Column, shown) -> Column:
    """The text with each of the sorted spans replaced by ``shown(span, at)``, ``at`` being the end of those before.

    Each block of spans works on its own piece of the text: to find a place in a text takes a walk from its start."""
    zero, far = F.lit(0).cast("bigint"), F.lit(2**31 - 1)
    end_of = lambda block: F.array_max(F.transform(block, lambda x: x["end"]))
    cut = lambda t, a, n: F.substring(t, (a + 1).cast("int"), n.cast("int"))

    def piece(block, begin, own):
        def step(acc, x):
            gap = F.when(x["start"] >= acc["at"], cut(own, acc["at"] - begin, x["start"] - acc["at"])).otherwise("")
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap, shown(x, acc["at"])).alias("out"))

        return F.aggregate(block, F.struct(begin.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    def whole(b):
        def joined(parts):
            ends = F.aggregate(parts, F.array(zero), lambda acc, p: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), end_of(p)))))
            one = lambda p, begin: _let(cut(b["text"], begin, F.greatest(zero, end_of(p) - begin)), lambda own: piece(p, begin, own))
            done = F.zip_with(parts, F.slice(ends, F.lit(1), F.size(parts)), one)
            return F.concat(F.array_join(done, ""), cut(b["text"], F.element_at(ends, -1), far))

        return _let(_blocks(b["spans"]), joined)

    return F.when(F.size(spans) > 0, _let(F.struct(text.alias("text"), spans.alias("spans")), whole)).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """The text with a private sign for each code point of the spans."""
    return _replaced(text, spans, lambda x, at: F.repeat(F.lit("\ue000"), F.greatest(F.lit(0).cast("bigint"), x["end"] - F.greatest(x["start"], at)).cast("int")))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind's mask; of overlapping spans the first one's mask stays."""
    mask = lambda x: reduce(lambda w, k: w.when(x["kind"] == k, MASKS[k]), MASKS, F.when(F.lit(False), ""))
    return _replaced(text, spans, lambda x, at: F.when(x["start"] >= at, mask(x)).otherwise(""))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with personal data masked and revealing terms removed or generalised in ``text_col``; null texts
    become empty. All columns stay; a column n_chars is brought up to date. Each row is masked where its spans are
    found."""
    found = with_spans(docs, id_col, text_col, **options).withColumn("clean", masked(F.col("text"), F.col("spans")))

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("clean").alias(c)
        return F.length("clean").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c)

    return found.select(*map(column, docs.columns))


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row."""
    found = find_personal_data(docs, id_col, text_col, **options)
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == k)).cast("long").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
