"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' ids. In each round, a window, a source earns its share of the window
as a quantum; what it has earned and not been served is its deficit, which it carries on. Ids are served one
at a time to the source whose deficit falls due first: id k (from 0) of a queue of T_s ids is due at
``(2k + 1) * T / (2 T_s)`` of T. The order is fixed by these numbers alone, so the ids that a queue has served
by the end of any window are known without playing the rounds before it, and any task can start at any window
with the deficits that earlier windows, in other tasks, have left.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnflow.llm.bpe import text_batches
from cairnflow.llm.scratch import scratch_table
from cairnflow.llm.tokens import byte_tokenizer

#: Numbers of ids served that a worker keeps, 8 bytes each.
KNOWN = 8_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids array<int>"


class Rounds:
    """Ids served to each queue by the end of each window; ``totals`` are the queues' lengths."""

    def __init__(self, totals: list[int], size: int):
        self.t, self.all, self.size = np.array(totals, np.int64), int(sum(totals)), size
        self.windows = -(-self.all // size)
        self.known: dict[int, np.ndarray] = {}

    def served(self, w: int) -> np.ndarray:
        """By queue, after ``w`` windows. Proportional service, then the due ids around the end one by one."""
        if w <= 0:
            return np.zeros(len(self.t), np.int64)
        if w >= self.windows:
            return self.t
        if w not in self.known:
            if len(self.known) * len(self.t) > KNOWN:
                self.known.clear()
            upto = w * self.size
            # Python integers: a product of two token counts may exceed 64 bits
            got = [min(t, (2 * upto * t + self.all) // (2 * self.all)) for t in self.t.tolist()]
            short = upto - sum(got)
            # got is off by less than one id a queue: a heap of the exact due times, of the next ids or the last ones
            step, t = (1, self.t.tolist()) if short > 0 else (-1, self.t.tolist())
            # quotients of numbers below 2**47 that differ do so by more than 2**-94
            due = lambda s: (step * ((2 * (got[s] if step > 0 else got[s] - 1) + 1 << 96) // t[s]), step * s)
            heap = [(*due(s), s) for s in range(len(got)) if short and (got[s] < t[s] if step > 0 else got[s])]
            heapq.heapify(heap)
            while short:
                s = heapq.heappop(heap)[2]
                got[s] += step
                short -= step
                if got[s] < t[s] if step > 0 else got[s]:
                    heapq.heappush(heap, (*due(s), s))
            self.known[w] = np.array(got, np.int64)
        return self.known[w]

    def window_of(self, s: int, k: int) -> int:
        """The window that serves id ``k`` of queue ``s``."""
        w = min(self.windows - 1, (2 * k + 1) * self.all // (2 * int(self.t[s]) * self.size))
        while self.served(w)[s] > k:
            w -= 1
        while self.served(w + 1)[s] <= k:
            w += 1
        return w

    def place(self, w: int, at: int, length: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of a run at ``at`` of window ``w``: the last window, if not full, is cut
        into sequences of descending powers of two, which need no padding."""
        full, rest = self.all // self.size, self.all % self.size
        if w < full:
            return [(w, at, length)]
        out, begin, sequence = [], 0, full
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                a, b = max(at, begin), min(at + length, begin + (1 << bit))
                if a < b:
                    out.append((sequence, a - begin, b - a))
                begin, sequence = begin + (1 << bit), sequence + 1
        return out


def _narrow(ids: np.ndarray) -> bytes:
    """Little-endian ids of 16 bits, which no id of the file may exceed."""
    if len(ids) and ids.max() > 65_535:
        raise ValueError("the queues hold ids of 16 bits; this tokeniser has larger ones")
    return ids.astype("<u2").tobytes()


def encode_queues(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, ids (16-bit little-endian, with the end id), chunk (the task) and chunk_start (ids of the
    same source before it in the task)."""

    def run(batches):
        from pyspark import TaskContext

        tok, end, chunk = byte_tokenizer(tokenizer), np.array([end_id], "<u4"), TaskContext.get().partitionId()
        upto: dict[str, int] = {}
        for part, texts in text_batches(batches):
            ids = [_narrow(np.concatenate((tok.ids(t), end))) for t in texts]
            sources, starts = part.column("source").to_pylist(), []
            for s, i in zip(sources, ids):
                starts.append(upto.get(s, 0))
                upto[s] = starts[-1] + len(i) // 2
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("source"), pa.array(ids, pa.binary()), pa.array([chunk] * len(ids), pa.int32()), pa.array(starts, pa.int64())],
                ["doc_id", "source", "ids", "chunk", "chunk_start"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    return rows.mapInArrow(run, "doc_id long, source string, ids binary, chunk int, chunk_start long")


def pack_mixture(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_sources: int = 100_000) -> DataFrame:
    """Pack every id of ``docs`` into sequences of ``size``; one row a piece: doc_id, start, length, ids_crc32
    (of its ids as 32-bit numbers), doc_tokens, sequence_id, offset, source, ids. A sequence is its pieces' ids by offset.

    Each window holds each source in its share of all tokens, to within rounding that is carried on. Null texts
    are empty and consist of the end id; a null source is the queue ''. Repeated rows are packed as often as they
    occur. An empty table gives no piece. Only the last window can be short; it is cut into powers of two.
    ``max_sources`` bounds the table of queue lengths that goes to every task; more sources raise an error.
    """
    queued = scratch_table(encode_queues(docs, tokenizer, end_id, id_col, text_col, source_col), "queues")
    # one row for each task and source that it met
    parts = queued.groupBy("source", "chunk").agg(F.sum(F.octet_length("ids") / 2).cast("long").alias("n"))
    order = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    parts = scratch_table(parts.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))), "chunks")
    totals = parts.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"over {max_sources} sources")
    # the planner broadcasts the chunks' bases if their table is small enough, and else shuffles by (source, chunk)
    placed = queued.join(parts.select("source", "chunk", "base"), ["source", "chunk"]).select(
        "doc_id", "source", "ids", (F.col("base") + F.col("chunk_start")).alias("at")
    )
    number, lengths = {r.source: k for k, r in enumerate(totals)}, [r.n for r in totals]

    def run(batches):
        rounds, out, held = Rounds(lengths, size), [], 0
        for batch in batches:
            for doc, source, raw, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "ids", "at"))):
                s, n, done = number[source], len(raw) // 2, 0
                data = np.frombuffer(raw, "<u2").astype("<u4")
                w = rounds.window_of(s, at)
                while done < n:
                    before, after = rounds.served(w), rounds.served(w + 1)
                    here = min(n - done, int(after[s]) - at - done)
                    if here > 0:
                        offset = int((after[:s] - before[:s]).sum()) + at + done - int(before[s])
                        for sequence, begin, length in rounds.place(w, offset, here):
                            piece = data[done : done + length]
                            out.append((doc, done, length, zlib.crc32(piece), n, sequence, begin, source, piece))
                            done, held = done + length, held + length
                    w += 1
                    if len(out) > 50_000 or held > 1_000_000:
                        yield _batch(out)
                        out, held = [], 0
        yield _batch(out)

    return placed.mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.string() if n == "source" else pa.int64() for n in names[:-1]]
    *columns, ids = list(zip(*rows)) if rows else [()] * len(names)
    ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
    pieces = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)))
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pieces], names)
