"""The classifier: its messages against enumeration, its accuracy on rows it has not seen."""

import itertools
import zlib

import numpy as np
import pytest

from cairnflow.llm import quality, queries


def test_messages_equal_enumeration():
    r = np.random.default_rng(0)
    per = np.array([3, 1, 5])
    u, a = r.normal(size=9), r.normal(size=(2, 2))
    f, b = quality.messages(u, per, a)
    at = 0
    for n in per:
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            weight[y] = np.exp(sum(u[at + k] * v for k, v in enumerate(y)) + sum(a[p, q] for p, q in zip(y, y[1:])))
        total = sum(weight.values())
        for k in range(n):
            assert quality._sigmoid(f[at + k] + b[at + k]) == pytest.approx(sum(w for y, w in weight.items() if y[k]) / total)
        at += n


def test_features_are_those_of_each_text_alone():
    texts = ["", "One line.", "a a a a a a\n\nTHE END!!\nb | c | d", "日本 x y\n", "long " * 5000]
    together = quality.line_features(texts)
    alone = [quality.line_features([t]) for t in texts]
    for k in range(3):
        assert np.allclose(together[k], np.concatenate([x[k] for x in alone]))
    assert together[2].tolist() == [1, 1, 4, 2, 1]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op10_quality(spark, sf).collect() if r.doc_id in labels]
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in got if r.held_out]
    good, bad = ([s for s, _, y in held if y == k] for k in (1, 0))
    assert np.mean([[g > x for x in bad] for g in good]) > 0.99
    assert np.mean([p == y for _, p, y in held]) > 0.98
    assert np.mean([p for _, p, y in held if y == 1]) > 0.99


def test_odd_rows(spark, make, sf):
    rows = [(1, None), (2, ""), (2, ""), (None, "x y z"), (4, "\n" * 3000), (5, "w" * 100_000)]
    field = quality.train_on(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    got = quality.score_documents(make(rows), field).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert quality.score_documents(make([]), field).count() == 0
    docs = make(rows)
    kept = quality.keep_good(docs, field)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_no_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(5)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_documents(docs, quality.train_on(docs, none)).collect()} == {0.5}
