"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from cairnflow.llm import components, exact_dedup, near_copies, simhash

LOWER = {i: i + 32 for i in range(65, 91)}
ROWS = [(1, "Ab"), (2, "aB"), (3, "ÄB"), (4, "äb"), (5, None), (6, ""), (7, "x"), (8, "x"), (8, "x"), (None, "x"), (None, "lonely"), (9, "X" * 200_000)] + [(100 + k, "HOT text") for k in range(60)]


def test_exact(make):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(make(ROWS), support=0.2).collect()), key=str)
    groups = {}
    for k, t in ROWS:
        groups.setdefault((t or "").translate(LOWER), []).append(k)
    want = []
    for t, ids in groups.items():
        keep = max((k for k in ids if k is not None), default=None)
        want += [(k, keep, len(ids), k == keep, hashlib.sha256(t.encode()).hexdigest()) for k in ids]
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_dedup(make([])).count() == 0


def test_drop_copies_keeps_columns(make):
    docs = make(ROWS)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == [2, 3, 4, 6, 8, 8, 9, 159]


def test_drop_copies_keeps_exactly_the_kept_rows(make):
    rows = [(8, "x"), (9, "X"), (8, "other text"), (None, "x"), (None, "other"), (None, "other"), (None, None), (3, ""), (4, "twice"), (4, "twice"), (2, "TWICE")]
    left = sorted(((r.doc_id, r.text) for r in exact_dedup.drop_copies(make(rows)).collect()), key=str)
    want = []
    for k, t in rows:
        ids = [i for i, u in rows if (u or "").translate(LOWER) == (t or "").translate(LOWER)]
        if k == max((i for i in ids if i is not None), default=None):
            want.append((k, t))
    assert left == sorted(want, key=str) and (8, "other text") in left and (None, "x") not in left


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


class Forest:
    """Union-find over positions; the smaller root wins."""

    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def near_rows():
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows, k = [(0, None), (1, " \t\n"), (2, "one"), (3, "One"), (4, "a b c"), (None, "one")], 10
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(5, 300))]
        for _ in range(r.randint(1, 8)):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((k, (" " if k % 2 else "\n").join(own).upper() if k % 3 else "  ".join(own)))
            k += 1
    return rows


def test_near(make):
    rows = near_rows()
    prints = np.array([fingerprint(t) for _, t in rows], np.uint64)
    forest = Forest(len(rows))
    for p, q in zip(*np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)):
        forest.join(int(p), int(q))
    members = {}
    for k, (i, _) in enumerate(rows):
        members.setdefault(forest.root(k), []).append(i)
    want = sorted(((i, f"{prints[k]:016x}", min(m for m in members[forest.root(k)] if m is not None)) for k, (i, _) in enumerate(rows)), key=str)
    for hot in (16_384, 6):  # with few rows a group, every path of the search is taken
        got = simhash.near_duplicates(make(rows), hot=hot).collect()
        assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(make([])).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(texts, similarity=0.8):
    """By position, the smallest position of its component of texts that are at least so similar."""
    sets, forest = [shingles(t) for t in texts], Forest(len(texts))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                forest.join(a, b)
    return [forest.root(k) for k in range(len(texts))]


def test_near_copies(make, monkeypatch):
    rows = near_rows()
    want = classes([t for _, t in rows])
    for task in (near_copies.TASK, 3_000):  # with little in a task, clumps are dealt into parts
        monkeypatch.setattr(near_copies, "TASK", task)
        got = near_copies.near_copies(make([(k, t) for k, (_, t) in enumerate(rows)])).collect()
        groups = {}
        for r in got:
            groups.setdefault(r.component, []).append(r.doc_id)
        # no link is wrong; that each true one is found is a matter of chance, which falls with the similarity
        assert all(len({want[k] for k in g}) == 1 for g in groups.values())
        assert len(groups) <= len(set(want)) + 1 and len(got) == len(rows)
    assert near_copies.near_copies(make([])).count() == 0


def test_unrelated_rows_are_no_candidates(spark):
    r = np.random.default_rng(8)
    x = r.integers(-(1 << 63), (1 << 63) - 1, (2, 3))
    near = x[0] ^ r.permutation([1 << 5, (1 << 9) + 1, 7])
    half = [x[0, 0] ^ 0b1011, *x[1, 1:]]  # 61 of the first 64 bits agree, of the others half
    rows = [(key, *map(int, w)) for w in (x[0], near, half) for key in (1, 2)]
    rows += [(key, k, k, k) for k in range(40) for key in (3, 4)]  # a run of over ``small`` rows
    rows += [(4, 0, -1, -1), (4, 1 << 62, 0, 0), (4, 1 << 61, -1, -1)]
    keyed = spark.createDataFrame(rows, "key long, fp long, fp1 long, fp2 long")
    for hot in (16_384, 6):
        got = {(e.a, e.b) for e in simhash.key_links(keyed, near_copies.MOST, hot).collect() if e.a != e.b}
        found = {e.node: e.component for e in components.connected_components(spark.createDataFrame(list(got), "a long, b long")).collect()}
        assert found[int(x[0, 0])] == found[int(near[0])] and int(half[0]) not in found
        assert {found[k] for k in range(40)} == {0} and found[1 << 62] == 0 and 1 << 61 in found


def test_candidates_are_few(make):
    r = np.random.default_rng(9)
    texts = [" ".join(f"w{k}" for k in r.integers(0, 10**6, 8)) for _ in range(12_000)]
    keyed = near_copies.keys(near_copies.prints(make(list(enumerate(texts))), 5, "doc_id", "text"))
    # rows that share a key by chance: about 3 in 10,000,000 pairs also agree in 46 of their first 64 bits
    assert simhash.key_links(keyed, near_copies.MOST).count() == 0
    assert simhash.key_links(keyed.select("key", "fp"), 18).count() > 0


def test_drop_near_copies(make):
    words = " ".join(f"w{k}" for k in range(100))
    rows = [(8, words + " x"), (9, words), (8, "other text that is alone"), (None, words + " y"), (None, None), (5, ""), (5, " "), (3, "one of a pair"), (3, "one of a pair"), (4, "One of a PAIR")]
    left = sorted(((r.doc_id, r.text) for r in near_copies.drop_near_copies(make(rows)).collect()), key=str)
    empty = [x for x in left if not (x[1] or "").strip()]
    assert sorted(set(left) - set(empty), key=str) == sorted({(8, words + " x"), (8, "other text that is alone"), (3, "one of a pair")}, key=str)
    assert [x[0] for x in empty] == [5] and left.count((3, "one of a pair")) == 2
    docs = make(rows)
    assert near_copies.drop_near_copies(docs).columns == docs.columns


def test_similar_links():
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 60, r.integers(0, 40)).astype(np.uint64)) for _ in range(200)]
    forest, found = Forest(200), Forest(200)
    for a in range(200):
        for b in range(a):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if x | y and len(x & y) >= 0.5 * len(x | y):
                forest.join(a, b)
    for a, b in near_copies.similar_links(np.arange(200), sets, 0.5):
        found.join(a, b)
    assert [forest.root(k) for k in range(200)] == [found.root(k) for k in range(200)]


def test_codewords():
    signs = near_copies.codewords()
    assert sorted(set((signs.T @ signs).astype(int)[0].tolist())) == [-9, -7, -1, 1, 7, 9, 23]
    noisy = np.random.default_rng(7).normal(size=(50, 192))
    both = np.concatenate((signs, -signs[:, ::-1]), axis=1)  # by number
    best = np.argsort(-(noisy[:, :23] @ both), axis=1)[:, :2]
    assert near_copies.decode(noisy)[:, 0].tolist() == best.tolist()


def test_long_text():
    text = " ".join(f"w{k % 977}" for k in range(30_000))
    assert simhash.fingerprint(text, chunk=1000) == simhash.fingerprint(text) == fingerprint(text)


def test_golay_neighbours():
    table = simhash.nearby()
    assert sorted(np.unique((table >= 0).sum(axis=1)).tolist()) == [1, 6]
    r = np.random.default_rng(3)
    u = r.integers(0, 1 << 22, 4000)
    a = simhash.codeword_indices(u)
    for d in (1, 2):
        v = u.copy()
        for k in range(len(v)):
            for b in r.choice(22, d, replace=False):
                v[k] ^= 1 << int(b)
        b = simhash.codeword_indices(v)
        assert ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_every_close_pair_shares_a_key():
    r = np.random.default_rng(4)
    f = r.integers(0, 1 << 63, 1500, dtype=np.uint64)
    g = f.copy()
    for k in range(len(g)):
        for b in r.choice(64, k % 5, replace=False):
            g[k] ^= np.uint64(1) << np.uint64(b)
    keys = []
    for x in (f, g):
        which, key = simhash.golay_keys(x.view(np.int64))
        keys.append([set() for _ in x])
        for w, k in zip(which.tolist(), key.tolist()):
            keys[-1][w].add(k)
    assert all(a & b for a, b in zip(*keys))


def test_runs_over_batches_and_limit():
    import pyarrow as pa

    key = np.repeat([1, 2, 3], [5, 400, 3])
    fp = np.concatenate([np.arange(5), np.arange(400), [0, 7, 1 << 40]]).astype(np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + 90]), pa.array(np.zeros(len(key[a : a + 90]), np.int32)), pa.array(fp[a : a + 90])], ["key", "part", "fp"]) for a in range(0, len(key), 90)]
    for limit in (10_000, 100):
        found = pa.Table.from_batches(list(simhash.bucket_links(iter(batches), 4, limit))).to_pylist()
        over = sorted(r["a"] for r in found if r["key"] is not None)
        assert over == ([] if limit == 10_000 else list(range(400)))
        assert any(r["key"] is None and {r["a"], r["b"]} == {0, 7} for r in found)


def test_components(spark):
    edges = [(k, k + 1) for k in range(200, 260)] + [(5, 5), (9, 3), (3, 9), (3, 4), (1000, 4)] + [(7000, k) for k in range(7001, 7100)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(200, 261), 200), 3: 3, 4: 3, 9: 3, 1000: 3, **dict.fromkeys(range(7000, 7100), 7000)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
