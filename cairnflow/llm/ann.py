"""Approximate nearest neighbours by a permutation index.

Pivots are spread vectors of a bounded sample. A vector is represented by the order in which the pivots lie
from it, nearest first, up to a prefix. An inverted file for each pivot holds the vectors in whose prefix it
stands, with its place there. For prefixes of m pivots, a pivot that stands at i for the query and at j for a
vector lowers their footrule distance (absent pivots count as place m) by ``2 (m - max(i, j))``, so the files of
the query's own prefix rank all vectors. The best are compared exactly.

Rows are dealt into index blocks and query blocks of bounded size, and each pair of blocks is one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnflow.llm.scratch import scratch_table

FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v of the rows that take part: no null, empty or zero vector, no null or non-finite component."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).filter("vec_id is not null").filter(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` distinct directions of the sample, each as far as possible from those before it."""
    unit = np.unique(sample / np.linalg.norm(sample, axis=1, keepdims=True), axis=0)
    taken, nearest = [0], unit @ unit[0]
    while len(taken) < min(n, len(unit)):
        taken.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[taken[-1]])
    return unit[taken]


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with one component more, which makes all as long as the longest: by angle, a query with 0 there
    has them in the order of their inner products, whatever their lengths."""
    return np.column_stack((vectors, np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))))


def inverted_files(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """A row for each pivot: ``prefix`` less its place for each vector, 0 where it is not in the prefix. With
    half of all pivots in a prefix, a byte for every vector is shorter than a list of vectors and places."""
    order = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix]
    files = np.zeros((len(pivots), len(vectors)), np.int16)
    files[order, np.arange(len(vectors))[:, None]] = prefix - np.arange(order.shape[1])
    return files


def _matrix(table: pa.Table) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def search_block(queries: pa.Table, index: pa.Table, pivots: np.ndarray, prefix: int, rerank: float, k: int, longest: float) -> pa.Table:
    """The ``k`` best of a block for each query: footrule ranks, then inner products in double precision.

    Equal vectors are ranked once and stand for their ``k + 1`` smallest ids, the only ones that can be found."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if queries.num_rows and index.num_rows:
        index = index.sort_by("vec_id")
        every, ids = _matrix(index), index.column("vec_id").to_numpy()
        vectors, which = np.unique(every, axis=0, return_inverse=True)
        which = which.reshape(-1)
        order = np.argsort(which, kind="stable")
        first = np.searchsorted(which[order], np.arange(len(vectors)))
        sizes = np.minimum(np.diff(np.append(first, len(order))), k + 1)
        files = inverted_files(lifted(vectors, longest), pivots, prefix)
        asked = _matrix(queries)
        near = np.argsort(-(asked @ pivots[:, :-1].T), axis=1, kind="stable")[:, :prefix]
        n = min(len(vectors), max(4 * k, int(np.ceil(rerank * len(vectors)))))
        for q, own, at in zip(queries.column("vec_id").to_pylist(), asked, near.tolist()):
            shared = np.zeros(len(vectors), np.int32)
            for place, pivot in enumerate(at):
                shared += np.minimum(files[pivot], prefix - place)
            best = np.argpartition(-shared, n - 1)[:n]
            score = (vectors[best] * own).sum(axis=1)
            if n > k + 1:
                keep = np.argpartition(-score, k)[: k + 1]
                keep = np.flatnonzero(score >= score[keep].min())
                best, score = best[keep], score[keep]
            rows = np.concatenate([order[first[b] : first[b] + sizes[b]] for b in best])
            score, found = np.repeat(score, sizes[best]), ids[rows]
            score, found = score[found != q], found[found != q]
            top = np.lexsort((found, -score))[:k]
            out.append((np.full(len(top), q), found[top], score[top]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, pivots: int = 256, prefix: int = 128, rerank: float = 0.12, sample: int = 4096, index_block: int = 4096, query_block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found by inner product, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own. Pivots
    come from the ``sample`` rows with the smallest hashes; every row is indexed. ``rerank`` is the share of each
    index block that is compared exactly; the recall is measured in tests/llm/test_ann.py on isotropic vectors of 64
    dimensions, of one length and of uneven ones, and on the driver's table. Vectors of another number of components
    than the commonest one (ties: the smaller) cannot be compared and take no part; null ids neither. Rows that repeat
    an id are candidates each; fewer than ``k`` candidates are all returned; an empty table gives an empty result.
    """
    rows = scratch_table(usable(vectors, id_col, vector_col), "vectors")
    commonest = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if commonest is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    rows = rows.filter(F.size("v") == commonest.n)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    longest = rows.agg(F.max(length)).first()[0]
    longest = longest if np.isfinite(longest) else 0.0
    drawn = np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()], np.float64)
    chosen = choose_pivots(lifted(drawn, longest), pivots)
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    index_blocks, query_blocks = max(1, -(-n // index_block)), max(1, -(-asked // query_block))
    part = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    over = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    index = rows.select("vec_id", "v", part(index_blocks).alias("i"), over(query_blocks).alias("q"))
    queries = rows.filter(F.col("vec_id") % every == 0).distinct().select("vec_id", "v", over(index_blocks).alias("i"), part(query_blocks).alias("q"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_block(left, right, chosen, min(prefix, len(chosen)), rerank, k, longest)

    found = queries.groupBy("i", "q").cogroup(index.groupBy("i", "q")).applyInArrow(search, FOUND)
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
