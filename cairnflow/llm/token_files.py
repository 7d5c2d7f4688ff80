"""Token ids in binary files of directly addressable codes.

An id is cut into chunks of 8 bits. Level 0 holds the lowest chunk of every id; a bitmap says which ids go on,
and level k + 1 holds the next chunk of those alone. A directory with the number of set bits before each block of
512 makes rank a lookup and at most eight popcounts, so any token is read by following one path through the
levels, without decoding a block. The last level, where no id goes on, has neither bitmap nor directory.

A file, little-endian throughout:
    8 bytes  "DACTOKS2"
    uint64   number of levels, ids, documents
    levels   uint64 number of chunks; chunks as bytes; padding to 8; bitmap words as uint64; directory as uint64
    int64    document ids (all bits set but the sign: null), then uint64 document starts and the end of the last
"""

from __future__ import annotations

import uuid
import zlib
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnflow.llm.bpe import text_batches
from cairnflow.llm.scratch import new_path, scratch_table
from cairnflow.llm.tokens import word_documents, word_tokenizer

MAGIC = b"DACTOKS2"
NULL_ID = np.iinfo(np.int64).max
MANIFEST = "shard int, part int, path string, docs long, tokens long"
#: Words of the bitmap in a block of the directory.
BLOCK = 8
#: Tokens of a file, but for a longer document, and bytes of a table that a task takes.
FILE_TOKENS, TASK_BYTES = 8_000_000, 256 << 20


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one file; ``ids`` of any unsigned type."""
    levels, rest, n_levels = [], ids, 0
    while True:
        n_levels += 1
        chunk, more = (rest & 255).astype(np.uint8), rest > 255
        levels += [np.array([len(chunk)], "<u8").tobytes(), chunk.tobytes(), b"\0" * (-len(chunk) % 8)]
        rest = rest[more] >> 8
        if not len(rest):
            break
        words = np.zeros(-(-len(more) // 64) * 8, np.uint8)
        bits = np.packbits(more, bitorder="little")
        words[: len(bits)] = bits
        counts = np.bitwise_count(words.view("<u8"))
        blocks = np.add.reduceat(counts, np.arange(0, len(counts), BLOCK), dtype=np.uint64)
        levels += [words.tobytes(), np.concatenate(([0], np.cumsum(blocks, dtype=np.uint64))).astype("<u8").tobytes()]
    starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.uint64))).astype("<u8")
    head = np.array([n_levels, len(ids), len(doc_ids)], "<u8").tobytes()
    return b"".join([MAGIC, head, *levels, doc_ids.astype("<i8").tobytes(), starts.tobytes()])


class TokenFile:
    """Random access to the tokens in the bytes that ``pack`` made."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n_levels, self.n, docs = np.frombuffer(data, "<u8", 3, 8).tolist()
        at, self.levels = 32, []
        for k in range(n_levels):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            chunk = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n + -n % 8
            words = -(-n // 64) if k < n_levels - 1 else 0
            blocks = -(-words // BLOCK) + 1 if words else 0
            self.levels.append((chunk, np.frombuffer(data, "<u8", words, at), np.frombuffer(data, "<u8", blocks, at + 8 * words)))
            at += 8 * (words + blocks)
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.starts = np.frombuffer(data, "<u8", docs + 1, at + 8 * docs).astype(np.int64)

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """The set bits of a level before each place."""
        _, words, before = self.levels[level]
        word, block = at >> 6, at >> 9
        out = before[block].astype(np.int64)
        for k in range(BLOCK):
            w = block * BLOCK + k
            whole = w < word
            out[whole] += np.bitwise_count(words[w[whole]])
        part = np.flatnonzero(at & 63)
        below = (np.uint64(1) << (at[part] & 63).astype(np.uint64)) - np.uint64(1)
        out[part] += np.bitwise_count(words[word[part]] & below)
        return out

    def tokens(self, at: np.ndarray) -> np.ndarray:
        """The ids at any positions, in any order."""
        at = np.asarray(at, np.int64)
        out, which = np.zeros(len(at), np.uint32), np.arange(len(at))
        for k, (chunk, words, _) in enumerate(self.levels):
            out[which] |= chunk[at].astype(np.uint32) << (8 * k)
            if not len(words) or not len(at):
                break
            more = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            at, which = self._rank(k, at[more]), which[more]
        return out

    def run(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """The ids from ``a`` to ``b``: in every level those that go on lie next to each other, too."""
        chunk, words, _ = self.levels[level]
        out = chunk[a:b].astype(np.uint32)
        if len(words) and len(out):
            first = a >> 6
            bits = np.unpackbits(words[first : (b - 1 >> 6) + 1].view(np.uint8), bitorder="little")
            more = np.flatnonzero(bits[a - 64 * first : b - 64 * first])
            if len(more):
                begin = int(self._rank(level, np.array([a]))[0])
                out[more] |= self.run(begin, begin + len(more), level + 1) << 8
        return out

    def document(self, k: int) -> np.ndarray:
        return self.run(int(self.starts[k]), int(self.starts[k + 1]))


def _open(path: str):
    """A file system that executors share, and the path in it: file:, hdfs:, s3: and so on."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _put(path: str, data: bytes) -> None:
    """Whole or not at all: an attempt that dies leaves no file under this name, and a second one replaces it."""
    files, at = _open(path)
    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, at)


def _tasks(df: DataFrame) -> int:
    """The session's shuffle partitions, and more where the planner expects a larger table."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // TASK_BYTES), 1_000_000))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode whole texts (null: empty), add ``end_id`` to each, and write them in ascending doc_id order.

    Files hold ascending, disjoint ranges of doc_id; null ids come first. A file ends with the document that brings
    it to ``file_tokens``. Rows with the same id are ordered, and dealt to tasks, by their texts' hashes; each row is
    written once. An empty table writes no file. Returns the manifest, one row a file: shard, part, path, docs,
    tokens. Memory: one file's ids, two to four bytes each.
    """

    def run(batches):
        from pyspark import TaskContext

        most = max(end_id, *word_tokenizer(tokenizer).token)
        kind = np.uint16 if most < 65536 else np.uint32
        shard, parts = TaskContext.get().partitionId(), count()
        doc_ids, lengths, data = [], [], []

        def flush():
            part, ids, every = next(parts), np.concatenate(data), np.concatenate(doc_ids)
            _put(path := f"{folder}/shard-{shard:06d}-{part:04d}.dac", pack(every, np.concatenate(lengths), ids))
            row = {"shard": shard, "part": part, "path": path, "docs": len(every), "tokens": len(ids)}
            doc_ids.clear(), lengths.clear(), data.clear()
            return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        for part, texts in text_batches(batches):
            ids, bounds = word_documents(tokenizer, texts)
            every = pc.fill_null(part.column("doc_id"), NULL_ID).to_numpy()
            ids, ends = np.insert(ids.astype(kind), bounds[1:], end_id), bounds + np.arange(len(bounds))
            at = 0
            while at < len(every):
                room = file_tokens - sum(map(len, data))
                end = min(int(np.searchsorted(ends, ends[at] + room)), len(every))
                doc_ids.append(every[at:end]), lengths.append(np.diff(ends[at : end + 1])), data.append(ids[ends[at] : ends[end]])
                at = end
                if sum(map(len, data)) >= file_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()
    ranged = rows.repartitionByRange(shards or _tasks(rows), *order).sortWithinPartitions(*order)
    return scratch_table(ranged.mapInArrow(run, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """From the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document."""

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                files, at = _open(path)
                with files.open_input_stream(at) as stream:
                    held = TokenFile(stream.read())
                for k in range(0, len(held.doc_ids), 1_000):
                    bounds = held.starts[k : k + 1_001]
                    tokens = memoryview(held.run(int(bounds[0]), int(bounds[-1])).astype("<u4", copy=False)).cast("B")
                    upto = ((bounds - bounds[0]) * 4).tolist()
                    crc = [zlib.crc32(tokens[a:b]) for a, b in zip(upto, upto[1:])]
                    ids = [None if d == NULL_ID else d for d in held.doc_ids[k : k + 1_000].tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(bounds[:-1] + start), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # one row a file: the window's single partition holds as many rows as there are files
    start = F.coalesce(F.sum("tokens").over(W.orderBy("shard", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("start", start)
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read every document back."""
    return read_token_files(write_token_files(docs, new_path(docs.sparkSession, "tokens"), tokenizer, end_id))
