"""Reply-ordered conversations from messages that quote each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnflow.llm.scratch import scratch_table

#: ``> text``, ``>> text``, ``> > text``: the markers of a line, and what stands behind them. The possessive repeat
#: is a loop in the engine; a plain one calls itself once a mark and overflows the stack of a deep quotation.
MARKS = r"^(?:[ \t]{0,3}>)++[ \t]?"
#: A line that introduces a quotation; it goes with the quotation that follows it.
INTRODUCTION = r"(?i)^[ \t]*+(?:.*\bwrote[ \t]*:|am\b(?=.*\bschrieb).*:|le\b.*\ba écrit[ \t]*:)[ \t]*$"


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def parse_lines(text: Column) -> Column:
    """A text as an array of lines: level (0: the message's own) and body without markers."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    return F.transform(lines, lambda x: F.struct(quote_level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("body")))


def own_text(parsed: Column) -> Column:
    """The message's own lines, without quotations and the lines that introduce them, trimmed."""
    after = F.concat(F.transform(F.slice(parsed, 2, F.size(parsed)), lambda x: x["level"]), F.array(F.lit(0)))
    rows = F.arrays_zip(parsed.alias("line"), after.alias("next"))
    own = F.filter(rows, lambda x: (x["line"]["level"] == 0) & ~((x["next"] > 0) & x["line"]["body"].rlike(INTRODUCTION)))
    return F.trim(F.array_join(F.transform(own, lambda x: x["line"]["body"]), "\n"), F.lit(" \t\n"))


def passage_hash(body: Column) -> Column:
    """Of a passage, here a line: lower case, white space as one space, none at the ends; null if nothing is left."""
    plain = F.trim(F.regexp_replace(F.lower(body), r"\s+", " "))
    return F.when(plain != "", F.sha2(plain, 256))


def _passages(messages: DataFrame, own: bool) -> DataFrame:
    kept = F.filter("parsed", lambda x: (x["level"] == 0) if own else (x["level"] > 0))
    rows = messages.select("conv_id", "turn", F.explode(F.transform(kept, lambda x: F.struct(x["level"].alias("level"), passage_hash(x["body"]).alias("hash")))).alias("p"))
    return rows.select("conv_id", "turn", "p.level", "p.hash").filter("hash is not null")


def link_quotations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, hash, source_turn: each quoted passage with the latest earlier message of the same
    conversation whose own words it repeats. Found by carrying the last original along each passage's turns, so a
    passage that many messages hold makes no pairs; passages that nobody quotes are left out beforehand."""
    quoted = scratch_table(_passages(messages, False).groupBy("conv_id", "turn", "hash").agg(F.min("level").alias("level")), "quoted")
    originals = _passages(messages, True).join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    originals = originals.groupBy("conv_id", "turn", "hash").agg(F.lit(None).cast("int").alias("level"))
    both = quoted.unionByName(originals)
    earlier = W.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    source = F.max(F.when(F.col("level").isNull(), F.col("turn"))).over(earlier)
    return both.withColumn("source_turn", source).filter("level is not null and source_turn is not null")


def _roots(links: DataFrame, rounds: int = 40) -> DataFrame:
    """conv_id, turn, root_turn, depth from conv_id, turn, reply_to, by doubling the jumps in each round."""
    up = scratch_table(links.select("conv_id", "turn", F.col("reply_to").alias("root_turn"), F.lit(1).cast("long").alias("depth")), "jumps")
    for _ in range(rounds):
        above = up.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("further"), F.col("depth").alias("more"))
        joined = up.join(above, ["conv_id", "root_turn"], "left")
        if joined.filter("further is not null").isEmpty():
            return up
        up = scratch_table(joined.select("conv_id", "turn", F.coalesce("further", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "jumps")
    raise RuntimeError("a chain of replies is longer than two to the number of rounds")


def as_replies(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The same messages as mail shows them: conv_id, turn, role, text. Below its own text each message quotes the
    one before it, introduced and with one mark a line, and in that the one before that with two. Messages follow
    each other by turn, repeated turns by text. Rows without conversation or turn quote nothing."""
    rows = messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    order = W.partitionBy("conv_id").orderBy("turn", F.xxhash64("text"))
    quoted = lambda body, mark: F.concat(F.lit(mark), F.replace(body, F.lit("\n"), F.lit("\n" + mark)))
    said = lambda k, c: F.lag(c, k).over(order)
    first = F.concat(F.lit("\n\n"), said(1, "role"), F.lit(" wrote:\n"), quoted(said(1, "text"), "> "))
    second = F.concat(F.lit("\n> "), said(2, "role"), F.lit(" wrote:\n"), quoted(said(2, "text"), ">> "))
    replies = rows.filter(whole).select("conv_id", "turn", "role", F.concat("text", F.coalesce(first, F.lit("")), F.coalesce(second, F.lit(""))).alias("text"))
    return replies.unionByName(rows.filter(~whole))


def build_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a message: conv_id, turn, role, content, reply_to, root_turn, depth, n_quoted, n_linked, formatted.

    ``content`` is the message without quotations; ``reply_to`` the message that most of its quoted passages of
    the lowest level come from (ties: the latest), null if it quotes none. Ordering a conversation's rows by
    (root_turn, turn) puts every message after the one it answers and keeps threads together. ``n_quoted`` counts
    its distinct quoted passages, ``n_linked`` those found in earlier messages. ``formatted`` is the message in chat
    markup. Null texts are empty; a null role is "user"; rows without conversation or turn link to nothing. Rows
    that repeat a conversation and turn are kept, and count as one message for links. An empty table gives none.
    """
    rows = messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.col(text_col).alias("text")
    )
    quoting = rows.filter(F.coalesce("text", F.lit("")).rlike(r"(?m)" + MARKS))
    # only conversations in which something is quoted are searched
    with_quotes = scratch_table(quoting.select("conv_id").filter("conv_id is not null").distinct(), "quoting")
    parsed = rows.join(with_quotes, "conv_id", "left_semi").select("conv_id", "turn", parse_lines(F.col("text")).alias("parsed"))
    linked = scratch_table(link_quotations(parsed.filter("turn is not null")), "links")
    lowest = W.partitionBy("conv_id", "turn")
    votes = linked.withColumn("lowest", F.min("level").over(lowest)).filter("level = lowest").groupBy("conv_id", "turn", "source_turn").agg(F.count(F.lit(1)).alias("n"))
    replies = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("n", "source_turn"))["source_turn"].alias("reply_to"))
    counted = linked.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked"))
    replies = scratch_table(replies, "replies")
    placed = scratch_table(replies.join(_roots(replies), ["conv_id", "turn"]).join(counted, ["conv_id", "turn"]), "placed")
    lines = parse_lines(F.col("text"))
    content = own_text(lines)
    passages = F.filter(F.transform(F.filter(lines, lambda x: x["level"] > 0), lambda x: passage_hash(x["body"])), lambda x: x.isNotNull())
    marked = F.coalesce("text", F.lit("")).rlike(r"(?m)" + MARKS)
    shown = rows.select("conv_id", "turn", "role", F.when(marked, content).otherwise(F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n"))).alias("content"), F.when(marked, F.size(F.array_distinct(passages))).otherwise(0).cast("long").alias("n_quoted"))
    full = shown.join(placed, ["conv_id", "turn"], "left")
    return full.select(
        "conv_id", "turn", "role", "content", "reply_to", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "content", F.lit("<|im_end|>")).alias("formatted"),
    )
