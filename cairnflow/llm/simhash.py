"""SimHash near-duplicates, searched with Golay codes.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. The binary Golay code of length 23 is perfect:
each segment, padded with zeros, lies within 3 bits of exactly one codeword. A segment's keys are the codewords
within 4 bits of it: its own one, and five more if that is 3 bits away. Two segments that differ in at most 2
bits share such a key. Proof: if a codeword c is nearest to u at distance e, and v differs from u in 2 bits,
then v is within e + 2 of c; for e + 2 = 5 the four positions of u's error and one of v's bits lie in one
codeword of weight 7 around c, which is within 4 of both.

At most 4 differing bits over three segments leave two cases. Either one segment is equal, and another differs
in at most 2 bits: keys of the equal segment's bits with a codeword of the other (34 bits). Or none is equal,
and all differ in at most 2: keys of three codewords (36 bits). Rows that share a key are compared.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.bpe import text_batches
from cairnflow.llm.components import connected_components
from cairnflow.llm.scratch import scratch_table

#: Bits of the segments, and bits that a link may differ in; the search holds for up to 4.
SEGMENTS, MOST = (22, 21, 21), 4
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the binary Golay code of length 23.
GENERATOR = 0b110001110101


def fingerprint(text: str, width: int = 4, chunk: int = 65_536) -> int:
    """Lower-case A-Z, words between ASCII white space, shingles of ``width`` words (or all words, if fewer),
    repeats included: a bit is set if set in over half of the shingles' XXH64 (seed 42). No words: 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, chunk):
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[k : k + chunk], ends[k : k + chunk])]
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of each row's whole text; null is empty."""

    def run(batches):
        for part, texts in text_batches(batches):
            fp = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
    return v


@lru_cache(maxsize=1)
def nearby() -> np.ndarray:
    """By syndrome, the up to 6 error patterns of weight 4 or less that lead to a codeword; -1 fills up.
    Patterns of weight 4 count only where the lightest has weight 3, and then there are five."""
    patterns = np.array([sum(1 << b for b in c) for k in range(5) for c in combinations(range(23), k)], np.int64)
    table, used = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for s, p in zip(_syndrome(patterns).tolist(), patterns.tolist()):
        table[s, used[s]] = p
        used[s] += 1
    return table


def codeword_indices(segment: np.ndarray) -> np.ndarray:
    """n x 6 numbers (12 information bits) of the codewords near each segment, -1 where there are fewer."""
    patterns = nearby()[_syndrome(segment)]
    return np.where(patterns >= 0, (segment[:, None] ^ patterns) >> 11, -1)


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints: which (its position), key."""
    bits, shift, segments = fp.view(np.uint64), 0, []
    for width in SEGMENTS:
        segments.append((bits >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64))
        shift += width
    near, out = [codeword_indices(s) for s in segments], []
    for tag, (i, j) in enumerate(permutations(range(3), 2)):
        keys = (tag << 34 | segments[i] << 12)[:, None] | near[j]
        out.append((keys, near[j] >= 0))
    three = near[0][:, :, None, None] << 24 | near[1][:, None, :, None] << 12 | near[2][:, None, None, :]
    held = (near[0][:, :, None, None] >= 0) & (near[1][:, None, :, None] >= 0) & (near[2][:, None, None, :] >= 0)
    out.append(((6 << 36 | three).reshape(len(fp), -1), held.reshape(len(fp), -1)))
    which = [np.nonzero(ok)[0] for _, ok in out]
    return np.concatenate(which), np.concatenate([k[ok] for k, ok in out])


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits each column of ``x`` differs from that of ``y`` (words x n)."""
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=0, dtype=np.uint16)


def links_within(fp: np.ndarray, most: int = MOST) -> np.ndarray:
    """n x 2 positions: each column of ``fp`` (words x n) that pairs at ``most`` bits or fewer connect to an earlier
    one, after the earliest that it is connected to. Each is compared with all after it that it is not connected to
    yet."""
    n = fp.shape[1]
    label = np.arange(n)
    for i in range(n - 1):
        at = np.flatnonzero((differing(fp[:, i + 1 :], fp[:, i : i + 1]) <= most) & (label[i + 1 :] != label[i])) + i + 1
        if len(at):
            labels = np.unique(label[at])
            label[np.isin(label, np.append(labels, label[i]))] = min(labels[0], label[i])
    at = np.flatnonzero(label != np.arange(n))
    return np.stack((label[at], at), axis=1)


def least_linked(values: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By position, the least value that links (positions x, y) connect it to."""
    least, changed = values.copy(), True
    while changed:
        both = np.minimum(least[x], least[y])
        changed = bool((both < least[x]).any() or (both < least[y]).any())
        np.minimum.at(least, x, both)
        np.minimum.at(least, y, both)
    return least


def _cells(pairs: np.ndarray, over: list[tuple[np.ndarray, np.ndarray]], words: list[str]) -> pa.RecordBatch:
    """Links as (a, b, null); rows of runs too large for the task as (fp, null, key). Further words of the rows
    follow, null for links."""
    key = np.concatenate([k for k, _ in over]) if over else np.zeros(0, np.int64)
    fp = np.concatenate([f for _, f in over], axis=1) if over else np.zeros((len(words), 0), np.int64)
    none = pa.nulls(len(pairs), pa.int64()), pa.nulls(len(key), pa.int64())
    a, b = pa.array(np.concatenate((pairs[:, 0], fp[0]))), pa.concat_arrays([pa.array(pairs[:, 1]), none[1]])
    rest = [pa.concat_arrays([none[0], pa.array(w)]) for w in (key, *fp[1:])]
    return pa.RecordBatch.from_arrays([a, b, *rest], ["a", "b", "key", *words[1:]])


def bucket_links(batches, most: int, limit: int, small: int = 24):
    """Links within each run of equal (key, part) in sorted batches of key, part and the words of a fingerprint, the
    first of which names it. Small runs are compared by shifting the whole batch, larger ones in blocks. A run may go
    over several batches; the rows of one with over ``limit`` rows are passed on, for ``key_links`` to deal out."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    over, words = None, []

    def emit(key, part, fp):
        cut = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        size, pairs, found, large = end - begin, [], [], []
        few, run = np.repeat(size <= small, size), np.repeat(np.arange(len(size)), size)
        for d in range(1, min(small, int(size.max(initial=0)))):
            x = np.flatnonzero((run[:-d] == run[d:]) & few[:-d])
            x = x[differing(fp[:, x], fp[:, x + d]) <= most]
            pairs.append((x, x + d))
        if pairs:  # each to the least that it is connected to: the same link in many runs, and no pairs
            x, y = (np.concatenate(c) for c in zip(*pairs))
            at = np.unique(np.concatenate((x, y)))
            found.append(np.stack((least_linked(fp[0], x, y)[at], fp[0][at]), axis=1))
        for k in np.flatnonzero(size > small).tolist():
            own = fp[:, begin[k] : end[k]]
            if size[k] > limit:
                large.append((key[begin[k] : end[k]], own))
                continue
            own = own[:, np.lexsort(own[::-1])]
            own = own[:, np.append(True, (own[:, 1:] != own[:, :-1]).any(axis=0))]
            found.append(own[0][links_within(own, most)])
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return _cells(np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0), large, words)

    def joined(parts):
        return [np.concatenate(c, axis=-1) for c in zip(*parts)]

    for batch in batches:
        words = [c for c in batch.schema.names if c not in ("key", "part")]
        key, part, *fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", *words))
        fp = np.stack(fp)
        if over is not None and len(key):
            same = int(np.argmin(np.append((key == over[0]) & (part == over[1]), False)))
            if same:
                yield _cells(np.zeros((0, 2), np.int64), [(key[:same], fp[:, :same])], words)
                key, part, fp = key[same:], part[same:], fp[:, same:]
        if not len(key):
            continue
        last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            held.append((key[:cut], part[:cut], fp[:, :cut]))
            yield emit(*joined(held))
            held = []
        held.append((key[cut:], part[cut:], fp[:, cut:]))
        if sum(len(h[0]) for h in held) > limit:
            over = held[0][0][0], held[0][1][0]
            yield _cells(np.zeros((0, 2), np.int64), [(k, f) for k, _, f in held], words)
            held = []
    if held:
        yield emit(*joined(held))


def _dealt(keyed: DataFrame, counts: DataFrame, hot: int) -> DataFrame:
    """key, part and the words of ``keyed``: the rows of keys in ``counts`` (key, n) go to pairs of parts of ``hot / 2`` rows each, so
    that every two rows meet; others keep part 0."""
    large = counts.select("key", F.ceil(F.col("n") * 2 / hot).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least(x, own) * F.col("parts") + F.greatest(x, own))
    parts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(both)
    return keyed.join(large, "key", "left").select(*keyed.columns, F.explode(parts).alias("part"))


def fingerprint_links(classes: DataFrame, most: int = MOST, hot: int = 16_384, support: float = 1e-4) -> DataFrame:
    """Links (a, b) between different fingerprints of ``classes`` (fp: long, distinct) that connect everything
    that pairs at ``most`` bits or fewer connect; ``most`` is at most 4."""
    if not 0 <= most <= 4:
        raise ValueError("the keys hold for up to 4 differing bits")

    def keys(batches):
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False)
            for k in range(0, len(every), 1_000):
                fp = every[k : k + 1_000]
                which, key = golay_keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[which])], ["key", "fp"])

    return key_links(classes.select("fp").mapInArrow(keys, "key long, fp long"), most, hot, support)


def key_links(keyed: DataFrame, most: int, hot: int = 16_384, support: float = 1e-4) -> DataFrame:
    """Links (a, b) between different fingerprints that share a key, rows (key, fp) of ``keyed``, which connect
    everything that such pairs at ``most`` bits or fewer connect. Columns after fp are further words of a fingerprint:
    all of them are compared, and links name the first; fingerprints with the same first word count as linked.

    Keys may be shared by many rows. Misra-Gries finds all with over ``support`` of the key rows, at most
    ``1 / support`` keys; those with over ``hot`` rows are dealt into parts before the shuffle. Other runs of over
    ``hot`` rows are met by the tasks, which pass them on to a second shuffle that deals them likewise. A task
    compares ``hot`` rows at a time; no row is dropped.
    """
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _, fp, *more = keyed.columns
    cells = ", ".join(f"{c} long" for c in ("a", "b", "key", *more))

    def met(dealt: DataFrame, limit: int) -> DataFrame:
        rows = dealt.select("key", "part", fp, *more).repartition(n, "key", "part").sortWithinPartitions("key", "part")
        return rows.mapInArrow(lambda batches: bucket_links(batches, most, limit), cells).distinct()

    of_key = lambda rows: rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    frequent = keyed.stat.freqItems(["key"], support).select(F.explode("key_freqItems").alias("key"))
    large = scratch_table(of_key(keyed.join(F.broadcast(frequent), "key", "left_semi")).filter(F.col("n") > hot), "hot")
    first = keyed.withColumn("part", F.lit(0)) if large.isEmpty() else _dealt(keyed, F.broadcast(large), hot)
    found = scratch_table(met(first, hot), "links")
    links, over = found.filter("key is null").select("a", "b"), found.filter("key is not null").select("key", F.col("a").alias(fp), *more)
    if over.isEmpty():
        return links
    return links.union(met(_dealt(over, of_key(over), hot), 1 << 62).select("a", "b"))


def near_duplicates(docs: DataFrame, width: int = 4, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", hot: int = 16_384) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach) of each row.

    Documents with equal fingerprints, which includes all texts without words and null texts, form a class; the
    search runs over classes. Null ids are never the smallest unless a component has no other. Repeated rows give
    repeated results, an empty table an empty one; other columns are not read.
    """
    prints = scratch_table(fingerprints(docs, width, id_col, text_col), "fingerprints")
    classes = scratch_table(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    nodes = connected_components(fingerprint_links(classes, most, hot))
    linked = classes.join(nodes, classes.fp == nodes.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    labels = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = scratch_table(linked.join(labels, "component").select("fp", "component_id"), "labels")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
