"""Token counts from an exact histogram of encoded lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnflow.llm.bpe import text_batches
from cairnflow.llm.scratch import scratch_table
from cairnflow.llm.tokens import byte_tokenizer

#: Lengths in a block of the two-level suffix sums.
BLOCK = 4096


def token_lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of each row's whole text; null and empty texts have none."""

    def run(batches):
        tok = byte_tokenizer(tokenizer)
        for part, texts in text_batches(batches):
            n = np.array([len(tok.ids(t)) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n)], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length that occurs, with sums over all documents at least and less long.

    n_tokens, n_docs; docs_ge and tokens_ge: documents of at least this length and their tokens; docs_lt and
    tokens_lt: the shorter ones; truncated_tokens: all tokens if texts are cut at this length; quantile: the
    share of documents at most this long. Null lengths are left out. Sums run within blocks of lengths and over
    the blocks' totals, so no task holds all lengths.
    """
    of_length = lengths.filter("n_tokens is not null").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = scratch_table(of_length.withColumn("block", F.floor(F.col("n_tokens") / BLOCK).cast("long")), "lengths")
    totals = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    base = totals.select("block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_lt") for c in "dt"), *(F.sum(c).over(whole).alias(f"{c}_all") for c in "dt"))
    within = W.partitionBy("block").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, -1)
    below = lambda x: F.coalesce(F.sum(x).over(within), F.lit(0))
    rows = counts.join(base, "block").select(
        "n_tokens", "n_docs", "d_all", "t_all",
        (F.col("d_lt") + below(F.col("n_docs"))).alias("docs_lt"),
        (F.col("t_lt") + below(F.col("n_docs") * F.col("n_tokens"))).alias("tokens_lt"),
    )
    ge = F.col("d_all") - F.col("docs_lt")
    return rows.select(
        "n_tokens", "n_docs", ge.alias("docs_ge"), (F.col("t_all") - F.col("tokens_lt")).alias("tokens_ge"), "docs_lt", "tokens_lt",
        (F.col("tokens_lt") + F.col("n_tokens") * ge).alias("truncated_tokens"),
        ((F.col("docs_lt") + F.col("n_docs")) / F.col("d_all")).alias("quantile"),
    )


def answer(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits: limit, docs_fitting, tokens_kept, tokens_cut, from the histogram's rows alone."""
    asked = histogram.sparkSession.createDataFrame([(x,) for x in limits], "limit long")
    row = F.struct("tokens_lt", "docs_ge")
    # the limits are the caller's short list and a join of ranges, not of all lengths with each other
    above = histogram.join(F.broadcast(asked), histogram["n_tokens"] > asked["limit"], "right").groupBy("limit").agg(F.min_by(row, "n_tokens").alias("next"))
    whole = histogram.agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    ge, lt = F.coalesce("next.docs_ge", F.lit(0)), F.coalesce("next.tokens_lt", "t", F.lit(0))
    kept = lt + F.col("limit") * ge
    return above.crossJoin(F.broadcast(whole)).select(
        "limit", (F.coalesce("d", F.lit(0)) - ge).alias("docs_fitting"), kept.alias("tokens_kept"), (F.coalesce("t", F.lit(0)) - kept).alias("tokens_cut")
    )
