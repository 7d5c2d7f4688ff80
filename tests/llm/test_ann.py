"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from cairnflow.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, x, k):
    out = {}
    for q in range(len(ids)):
        if ids[q] % 20 == 0:
            score = (x * x[q]).sum(axis=1)
            order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
            out[int(ids[q])] = [(int(ids[i]), score[i]) for i in order]
    return out


@pytest.mark.parametrize("uneven", [False, True])
def test_recall_on_isotropic_vectors(spark, uneven):
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) * (r.lognormal(sigma=0.5, size=(4000, 1)) if uneven else 1)).astype(np.float32)
    ids = np.arange(4000)
    df = spark.createDataFrame([(int(i), v.tolist(), "c") for i, v in zip(ids, x)], SCHEMA + ", rank string")
    want, got = brute(ids, x.astype(np.float64), 20), {}
    for row in ann.nearest(df, index_block=1500, query_block=80).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [f[1:] for f in found] == sorted((f[1:] for f in found), key=lambda f: (-f[1], f[0]))
        for _, v, s in found:
            assert math.isclose(s, float((x[q].astype(np.float64) * x[v].astype(np.float64)).sum()), rel_tol=1e-12, abs_tol=1e-15)
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_copies_and_unusable_vectors(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8)).astype(np.float32)
    x[100:200] = x[100]  # a third of all rows are the same
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (920, []), (940, [0.0] * 8), (960, [float("nan")] * 8), (980, [1.0] * 7 + [float("inf")]), (1000, [1.0] * 7 + [None]), (None, [1.0] * 8), (1020, [1.0] * 9)]
    got = {}
    for row in ann.nearest(spark.createDataFrame(rows + odd, SCHEMA), index_block=128, query_block=7, rerank=1.0).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id))
    want = brute(np.arange(300), x.astype(np.float64), 20)
    assert {q: [v for _, v in sorted(f)] for q, f in got.items()} == {q: [v for v, _ in f] for q, f in want.items()}


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.nearest(few.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want = brute(ids, x, 20)
    found = ann.nearest(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = sum(len(got[q] & {v for v, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))
    print("recall", recall)
    assert recall >= 0.9


def test_the_commonest_number_of_components_takes_part(spark):
    r = np.random.default_rng(3)
    rows = [(k, r.normal(size=3).tolist()) for k in range(59)] + [(100, [1.0, 2.0]), (120, [2.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 * 20 and {r.query_id for r in got} == {0, 20, 40}
