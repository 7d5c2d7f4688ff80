"""Exact deduplication with a heavy-hitter split.

A Misra-Gries pass (``freqItems``) over the digests yields at most ``1 / support`` candidates that contain
every digest with more than ``support`` of the rows. One aggregation verifies them; the verified winners, a
table of at most ``1 / support`` rows whatever the input, are broadcast and decide their rows on the map side.
All other digests, none of which holds more than ``support`` of the rows, meet in an ordinary shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.scratch import scratch_table


def text_digest(text: Column) -> Column:
    """SHA-256 in lowercase hex of the text with A-Z, and only those, in lower case; null counts as empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.sha2(plain, 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of its group stays. Null and empty texts form one group. A null id loses to
    any other; a group with null ids only has a null keep_id and keeps its rows. Rows that repeat the id that
    stays are all marked kept. An empty table gives an empty result; other columns are not read.
    """
    slim = scratch_table(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256")), "digests")
    frequent = slim.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    of_group = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    verified = slim.join(F.broadcast(frequent), "text_sha256", "left_semi").groupBy("text_sha256").agg(*of_group)
    winners = scratch_table(verified.filter("group_size > 1"), "winners")
    split = slim.join(F.broadcast(winners), "text_sha256", "left")
    hot = split.filter("group_size is not null")
    cold = split.filter("group_size is null").select("doc_id", "text_sha256")
    # summed on the map side first: a group just below ``support`` of the rows is a row a task in the shuffle
    groups = cold.groupBy("text_sha256").agg(*of_group)
    cold = cold.join(groups, "text_sha256")
    return hot.unionByName(cold).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` does not keep; all columns stay.

    Rows are told apart by id and text: of rows that share an id, each stays or goes with its own text's group.
    """
    dropped = exact_dedup(docs, id_col, text_col, support).filter("not kept").select("doc_id", "text_sha256").distinct()
    # as many rows as copies: a shuffle at every size, and no broadcast that small tables would get
    dropped = scratch_table(dropped, "dropped").hint("merge")
    same = docs[id_col].eqNullSafe(dropped["doc_id"]) & (text_digest(docs[text_col]) == dropped["text_sha256"])
    return docs.join(dropped, same, "left_anti")
