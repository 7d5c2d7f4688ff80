"""The pipeline's stages on each one's own input, against plain code."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cairnflow.llm import pii, quality, queries
from cairnflow.llm.scratch import scratch_table
from tests.llm.test_dedup import LOWER, classes


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = scratch_table(stage(spark, docs, sf), "stage")
        out[name] = docs, after
        docs = after
    return out


def test_columns(stages):
    for docs, after in [*stages.values()][:-1]:
        assert after.columns == docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert after.dtypes == docs.dtypes


def test_quality(spark, sf, stages):
    docs, after = stages["quality classifier"]
    field = quality.train_on(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = docs.collect()
    kept = {r.doc_id for r, s in zip(rows, field.scores([r.text for r in rows])) if s >= 0.7}
    assert {r.doc_id for r in after.collect()} == kept and 0.7 < len(kept) / len(rows) < 1


def test_exact(stages):
    docs, after = stages["exact dedup"]
    keep = {}
    for r in docs.collect():
        t = r.text.translate(LOWER)
        keep[t] = max(keep.get(t, -1), r.doc_id)
    assert {r.doc_id for r in after.collect()} == set(keep.values())


def test_near(stages):
    docs, after = stages["simhash near-dedup"]
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    first = classes([r.text for r in rows])
    kept = {r.doc_id for r in after.collect()}
    assert kept >= {rows[k].doc_id for k in set(first)} and len(kept) <= len(set(first)) + 1


def test_pii(stages):
    docs, after = stages["pii"]
    found = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    for r in after.collect():
        text, at, out = found[r.doc_id].text, 0, []
        for s in found[r.doc_id].spans:
            if s.start >= at:
                out += [text[at : s.start], pii.MASKS[s.kind]]
            at = max(at, s.end)
        assert r.text == "".join(out) + text[at:] and r.n_chars == len(r.text)
    assert any(f.spans for f in found.values()) and after.count() == docs.count()


def test_packing(stages):
    docs, after = stages["packing"]
    tok = Tokenizer.from_file(queries.BYTE)
    want = {r.doc_id: np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    seen = Counter()
    for r in after.collect():
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
    assert seen == {k: len(v) for k, v in want.items()}


def test_run(spark, sf, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, stages["packing"][1].collect()))


def test_all_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())
