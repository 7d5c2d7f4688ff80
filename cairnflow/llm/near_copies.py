"""Near copies by similarity of their shingles, found by SimHash with soft Golay decoding.

The rule is Jaccard similarity of the sets of five-word shingles. Two sets at 0.8 differ in some 15 % of the bits of
their SimHash fingerprints, far more than a search by exact distance can bridge, but the bits that differ are
mostly those that were won by a narrow margin. So a fingerprint of eight segments of 23 bits is kept with its
margins, and each segment is decoded to the two codewords of the Golay code that agree best with the margins. Two
sets at 0.8 share one of them in about half of all segments; by the pigeonhole principle two that agree in any two
segments share a key of two codewords. Rows that share a key and differ in at most 54 of all 192 bits are candidates.
Fewer bits would not do: the two segments of a shared key agree anyway, and in the rest of 64 bits so many unrelated
rows agree by chance that, from some millions of rows, most are linked to one another.

Candidates are verified exactly: those that candidate links connect meet, and only pairs of a similarity of at least
0.8 become links.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.bpe import text_batches
from cairnflow.llm.components import connected_components
from cairnflow.llm.scratch import scratch_table
from cairnflow.llm.simhash import _syndrome, key_links
from cairnflow.llm.tokens import gather

SEGMENTS, BITS, NEAREST = 8, 23, 2
#: The words of a fingerprint, and how many of their bits a candidate may differ in.
WORDS, MOST = ("fp", "fp1", "fp2"), 54
#: Shingles, with ROW for each set, that a task compares at a time.
TASK, ROW = 1_000_000, 500


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """The sorted XXH64 (seed 42) of the distinct shingles of ``width`` words (all words, if fewer) between ASCII
    white space, A-Z in lower case."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())), np.uint64, n))


def set_id(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes())).view(np.int64))


def margins(shingles: np.ndarray, chunk: int = 65_536) -> np.ndarray:
    """For each of 192 bits, by how many more shingles have it set than not."""
    ones = np.zeros(192, np.int64)
    for k in range(0, len(shingles), chunk):
        h = shingles[k : k + chunk]
        for word in range(3):
            ones[64 * word : 64 * word + 64] += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            # the next word: another finaliser over the same hash
            h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            h = h ^ h >> np.uint64(31)
    return 2 * ones - len(shingles)


@lru_cache(maxsize=1)
def codewords() -> np.ndarray:
    """23 x 2048 signs: of each pair of a codeword and its complement, the one with the highest bit clear."""
    words = np.arange(2048, dtype=np.int64) << 11
    words ^= _syndrome(words)
    return (2.0 * (words[None, :] >> np.arange(BITS)[:, None] & 1) - 1).astype(np.float32)


def decode(signed: np.ndarray) -> np.ndarray:
    """n x 8 x 2 numbers (12 bits) of the codewords that agree best with the margins (n x 192) of each segment."""
    x = signed[:, : SEGMENTS * BITS].reshape(-1, BITS).astype(np.float32)
    agree = x @ codewords()
    size, out = np.abs(agree), np.empty((len(x), NEAREST), np.int64)
    rows = np.arange(len(x))
    for k in range(NEAREST):
        best = size.argmax(axis=1)
        out[:, k] = np.where(agree[rows, best] >= 0, best, 4095 - best)
        size[rows, best] = -1
    return out.reshape(-1, SEGMENTS, NEAREST)


def prints(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_id, set_id, n (shingles), fp, fp1, fp2 (the bits), codes (16 numbers) of each row."""

    def run(batches):
        for part, texts in text_batches(batches):
            for k in range(0, len(texts), 256):
                sets = [shingle_set(t, width) for t in texts[k : k + 256]]
                signed = np.stack([margins(s) for s in sets])
                fp = np.packbits(signed > 0, axis=1, bitorder="little").view("<i8")
                codes = decode(signed).reshape(len(sets), -1).astype(np.int32)
                own = part.slice(k, len(sets))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("text_id"), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(w, pa.int64()) for w in fp.T], lists],
                    ["doc_id", "text_id", "set_id", "n", *WORDS, "codes"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    return rows.mapInArrow(run, "doc_id long, text_id long, set_id long, n long, fp long, fp1 long, fp2 long, codes array<int>")


def keys(classes: DataFrame) -> DataFrame:
    """key, fp, fp1, fp2: a row for each two segments and each two of their codewords."""
    codes, each = F.col("codes"), []
    for number, (i, j) in enumerate(combinations(range(SEGMENTS), 2)):
        for a in range(NEAREST):
            for b in range(NEAREST):
                pair = F.get(codes, F.lit(i * NEAREST + a)) * 4096 + F.get(codes, F.lit(j * NEAREST + b))
                each.append(F.lit(number << 24).cast("long") + pair)
    return classes.select(F.explode(F.array(*each)).alias("key"), *WORDS)


def similar_links(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (ids) that connect what pairs of sets of at least this similarity connect: fewer than sets. All pairs
    are compared but those that links connect already, by lists of the sets that hold each shingle."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    every, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(n), sizes)
    order = np.argsort(every, kind="stable")
    new = np.concatenate(([True], every[order][1:] != every[order][:-1])) if len(every) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(every)))
    group = np.empty(len(every), np.int64)
    group[order] = np.cumsum(new) - 1
    holders, upto = owner[order], np.concatenate(([0], np.cumsum(sizes)))
    label, out = np.arange(n), []
    for i in range(n - 1):
        open_ = (label != label[i]) & (sizes >= similarity * sizes[i]) & (sizes * similarity <= sizes[i])
        open_[: i + 1] = False
        if not open_.any():
            continue
        g = group[upto[i] : upto[i + 1]]
        g = g[length[g] > 1]
        common = np.bincount(gather(holders, begin[g], length[g]), minlength=n)
        at = np.flatnonzero(open_ & (common / np.maximum(sizes + sizes[i] - common, 1) >= similarity))
        if len(at):
            labels, first = np.unique(label[at], return_index=True)
            out += [(int(ids[i]), int(ids[j])) for j in at[first]]
            label[np.isin(label, np.append(labels, label[i]))] = min(labels[0], label[i])
    return out


def similar_sets(rows: DataFrame, docs: DataFrame, width: int, similarity: float, most: int, hot: int, text_col: str) -> DataFrame:
    """Links (a, b) between the set_ids of ``prints``, verified on the texts of ``docs``."""
    classes = rows.groupBy("set_id").agg(*[F.min(w).alias(w) for w in WORDS], F.min("codes").alias("codes"), F.min("n").alias("n"), F.min("text_id").alias("text_id"))
    classes = scratch_table(classes, "classes")
    clumps = connected_components(key_links(keys(classes), most, hot))
    placed = classes.join(clumps, classes.fp == clumps.node, "left").select("set_id", "text_id", "n", F.coalesce("component", "fp").alias("clump"))
    of_clump = placed.groupBy("clump").agg(F.count(F.lit(1)).alias("sets"), F.ceil((F.sum("n") + F.count(F.lit(1)) * ROW) * 2 / TASK).cast("int").alias("parts"))
    of_clump = of_clump.filter("sets > 1").withColumn("parts", F.when((F.col("sets") < 3) | (F.col("parts") <= 2), 1).otherwise(F.col("parts")))
    members = scratch_table(placed.join(of_clump, "clump").select("text_id", "set_id", "clump", "parts"), "members")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("text_id"), text.alias("text")).join(members.select("text_id").hint("merge"), "text_id", "left_semi")
    texts = texts.groupBy("text_id").agg(F.first("text").alias("text"))

    def shingles(batches):
        for part, own in text_batches(batches):
            sets = [shingle_set(t, width).astype("<u8").tobytes() for t in own]
            yield pa.RecordBatch.from_arrays([part.column("text_id"), pa.array(sets, pa.binary())], ["text_id", "shingles"])

    def verify(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s, "<u8") for s in group.column("shingles").to_pylist()]
        links = similar_links(group.column("set_id").to_numpy(), sets, similarity)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    # a clump too large for a task is dealt into parts, of which every two meet
    own = F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least(x, own) * F.col("parts") + F.greatest(x, own))
    held = texts.mapInArrow(shingles, "text_id long, shingles binary").join(members, "text_id")
    dealt = held.select("clump", "set_id", "shingles", F.explode(pairs).alias("part"))
    return dealt.groupBy("clump", "part").applyInArrow(verify, "a long, b long")


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", hot: int = 16_384) -> DataFrame:
    """doc_id, text_id, set_id, component (a set_id) of each row: components of texts whose sets of shingles are at
    least ``similarity`` alike, as found. Texts with the same set, which includes all without words, are one.
    Repeated rows give repeated results, an empty table an empty one; other columns are not read."""
    rows = scratch_table(prints(docs, width, id_col, text_col), "prints")
    nodes = connected_components(scratch_table(similar_sets(rows, docs, width, similarity, most, hot, text_col), "similar"))
    joined = rows.join(nodes, rows.set_id == nodes.node, "left")
    return joined.select("doc_id", "text_id", "set_id", F.coalesce("component", "set_id").alias("component"))


def drop_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component of ``near_copies``; all columns stay.

    The smallest id stays, null after all others; of two texts with that id the one with the smaller hash. Rows that
    repeat the one that stays, id and text, stay too. Rows are told apart by id and text.
    """
    rows = scratch_table(near_copies(docs, width, similarity, id_col=id_col, text_col=text_col), "components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_id").alias("text"))
    first = rows.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("component", "first")
    losers = rows.join(first, "component").filter(~(F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_id") == F.col("first.text"))))
    # as many rows as copies: a shuffle at every size, and no broadcast that small tables would get
    dropped = scratch_table(losers.select("doc_id", "text_id").distinct(), "dropped").hint("merge")
    same = docs[id_col].eqNullSafe(dropped["doc_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == dropped["text_id"])
    return docs.join(dropped, same, "left_anti")
