"""Tokenisers, encoding, files, packing and counts against the tokenizers library and plain models."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cairnflow.llm import bpe, packing, token_counts, token_files, tokens

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
ODD = ["", "  a  b", "a   b\n\n  c\t d", "x<|endoftext|> y <|startoftext|>z", " lead", "trail ", "it's we'LL 12345 ½ ΣΑΣ İstanbul é Å", "a\x1cb\x1fc\x85d e　f", "​᠎ ﻿ q", "日本語 text 👍🏽 ok\r\n\r\n x", "aaaaaaa " * 3000]
_r = random.Random(1)
ODD += ["".join(_r.choice(" \n\tab's.1é👍<|>Σ\x1d\xa0") for _ in range(_r.randint(0, 40))) for _ in range(400)]
ROWS = [*enumerate(ODD), (5000, None), (5001, "same"), (5001, "same"), (None, "no id")]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


def test_word_ids(word):
    ids, bounds = tokens.word_documents(WORD, ODD)
    for k, t in enumerate(ODD):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == word.encode(t, add_special_tokens=False).ids


def test_byte_ids(byte):
    tok = tokens.byte_tokenizer(BYTE)
    for t in ODD:
        assert tok.ids(t).tolist() == byte.encode(t, add_special_tokens=False).ids


def test_pair_index_merges_by_rank():
    vocab = {c: k for k, c in enumerate(["a", "b", "c", "ab", "abc", "aa"])}
    index = tokens.PairIndexBpe(vocab, [("a", "a"), ("a", "b"), ("ab", "c")])
    words = ["aaab", "abc", "aaaa", "c", "aaa"]
    ids, counts = index.encode(np.array([vocab[c] for w in words for c in w], np.int32), np.array([len(w) for w in words]))
    names = list(vocab)
    assert [names[i] for i in ids] == ["aa", "ab", "abc", "aa", "aa", "c", "aa", "a"] and counts.tolist() == [2, 1, 2, 1, 2]


def test_lexicon_trims(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    lexicon, tok = tokens.Lexicon(tokens.word_tokenizer(WORD).encode), Tokenizer.from_file(WORD)
    for k in range(6):
        texts = [f"common word{j} other{j * k}" for j in range(30)]
        ids, bounds = lexicon.documents(pa.array(texts, pa.large_string()))
        for j, t in enumerate(texts):
            assert ids[bounds[j] : bounds[j + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_round_trip_digests(make, word):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(make(ROWS), WORD).collect())
    want = Counter()
    for k, t in ROWS:
        ids = word.encode(t or "", add_special_tokens=False).ids
        want[k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want


def test_encode_decode(make, word):
    encoded = bpe.encode_documents(make(ROWS[:60]), WORD)
    decoded = {r.doc_id: r.text for r in bpe.decode_documents(encoded, WORD).collect()}
    assert decoded == {k: word.decode(word.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for k, t in ROWS[:60]}
    assert bpe.encode_documents(make([]), WORD).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65536, 2**24, 2**32 - 1], list(range(0, 70000, 7))])
def test_token_file(ids):
    data = np.array(ids, np.uint32)
    held = token_files.TokenFile(token_files.pack(np.array([7, 9]), np.array([1, max(len(ids) - 1, 0)]), data))
    assert held.tokens(np.arange(len(ids))).tolist() == ids
    at = np.random.default_rng(0).permutation(len(ids))
    assert held.tokens(at).tolist() == data[at].tolist()
    assert held.doc_ids.tolist() == [7, 9]
    cuts = sorted(np.random.default_rng(1).integers(0, len(ids) + 1, 40).tolist())
    for a, b in zip(cuts, cuts[1:]):
        assert held.run(a, b).tolist() == ids[a:b]


def test_token_files_are_bounded_and_ordered(spark, word):
    rows = [(7, f"text {k}") for k in range(300)] + [(k, "word " * k) for k in range(60)] + [(None, "a b")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_files.write_token_files(docs, token_files.new_path(spark, "t"), WORD, shards=3, file_tokens=100)
    files = manifest.orderBy("shard", "part").collect()
    assert sum(f.docs for f in files) == len(rows) and len(files) > 10
    assert max(f.tokens for f in files) < 100 + 61 and max(f.part for f in files) > 0
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_store_tokens(make, word):
    rows = ROWS[:-1]
    got = sorted(tuple(r) for r in token_files.store_tokens(make(rows), WORD).collect())
    start, want = 0, []
    for k, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*word.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert token_files.store_tokens(make([]), WORD).count() == 0


def test_histogram(make, byte):
    lengths = [len(byte.encode(t or "", add_special_tokens=False).ids) for _, t in ROWS]
    histogram = token_counts.length_histogram(token_counts.token_lengths(make(ROWS), BYTE)).cache()
    for r in histogram.collect():
        n = r.n_tokens
        assert r.n_docs == lengths.count(n)
        assert (r.docs_ge, r.docs_lt) == (sum(x >= n for x in lengths), sum(x < n for x in lengths))
        assert (r.tokens_ge, r.tokens_lt, r.truncated_tokens) == (sum(x for x in lengths if x >= n), sum(x for x in lengths if x < n), sum(min(x, n) for x in lengths))
        assert r.quantile == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    for r in token_counts.answer(histogram, [0, 1, 7, 100, 10**6]).collect():
        assert (r.docs_fitting, r.tokens_kept, r.tokens_cut) == (sum(x <= r.limit for x in lengths), sum(min(x, r.limit) for x in lengths), sum(max(x - r.limit, 0) for x in lengths))
    assert token_counts.length_histogram(token_counts.token_lengths(make([]), BYTE)).count() == 0


def test_rounds_serve_in_proportion():
    totals, size = [5000, 1, 300, 0, 2699, 41], 64
    rounds = packing.Rounds(totals, size)
    last = np.zeros(len(totals), np.int64)
    for w in range(rounds.windows + 1):
        now = rounds.served(w)
        assert (now >= last).all() and now.sum() == min(w * size, sum(totals))
        assert all(abs(n - w * size * t / sum(totals)) <= len(totals) / 2 + 1 for n, t in zip(now, totals) if w < rounds.windows)
        last = now
    for s, t in enumerate(totals):
        for k in range(0, t, 37):
            w = rounds.window_of(s, k)
            assert rounds.served(w)[s] <= k < rounds.served(w + 1)[s]


def test_packing(spark, byte):
    rows = [(k, t, f"s{k % 3}" if k % 7 else None) for k, t in ROWS if k is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = packing.pack_mixture(docs, BYTE, size=256).collect()
    ids = {k: np.array([*byte.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t, _ in rows}
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    copies = Counter(k for k, _, _ in rows)
    for k, own in pieces.items():
        covered = Counter(i for r in own for i in range(r.start, r.start + r.length))
        assert set(covered.values()) == {copies[k]} and len(covered) == len(ids[k])
    assert set(pieces) == set(ids)
    sizes = []
    for _, own in sorted(sequences.items()):
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    full = sum(sizes) // 256
    assert sizes[:full] == [256] * full and all(s & (s - 1) == 0 for s in sizes[full:])
    assert packing.pack_mixture(docs.limit(0), BYTE).count() == 0


def test_packed_sequences_hold_their_tokens(spark, byte):
    rows = [(k, t, f"s{k % 3}") for k, t in ROWS if k is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = {k: [*byte.encode(t or "", add_special_tokens=False).ids, 1] for k, t, _ in rows}
    sequences = Counter()
    for r in packing.pack_mixture(docs, BYTE, size=256).collect():
        assert r.ids == want[r.doc_id][r.start : r.start + r.length] and len(r.ids) == r.length
        sequences[r.sequence_id] += len(r.ids)
    assert sum(sequences.values()) == sum(len(want[k]) for k, _, _ in rows) and sequences[0] == 256


def test_too_many_sources(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="sources"):
        packing.pack_mixture(docs, BYTE, max_sources=1)
