"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad. Its own features and those of the lines before and after it speak for
either label, and a matrix of transitions ties neighbouring labels together. Forward and backward messages give
each line's marginal; their mean, weighted by the lines' lengths, is the document's.

With two labels a message is one number, the log odds of "good", and all documents of a batch go through the
recursion together, place by place.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnflow.llm.bpe import text_batches
from cairnflow.llm.scratch import scratch_table

#: Characters whose features a worker holds at a time, some 30 bytes each.
CHARS = 2_000_000
CLASSES = ("lower", "upper", "digit", "space", "stop", "bang", "bar", "quote", "symbol", "other")
N_FEATURES = 19


@lru_cache(maxsize=1)
def _char_classes() -> np.ndarray:
    """The class of each code point; those above the table's end count as lower-case letters."""
    named = {".": 4, ",": 4, ";": 4, ":": 4, "!": 5, "?": 5, "|": 6, "'": 7, '"': 7, "-": 7, "(": 7, ")": 7}
    kinds = {"Ll": 0, "Lm": 0, "Lo": 0, "Lu": 1, "Lt": 1, "Nd": 2, "Nl": 2, "No": 2, "Zs": 3, "Cc": 3, "Mn": 0, "Mc": 0}
    out = np.zeros(0x3000, np.int64)
    for c in range(len(out)):
        kind = unicodedata.category(chr(c))
        out[c] = named.get(chr(c), kinds.get(kind, 8 if kind[0] in "PS" else 9))
    return out


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of the texts: features, lengths; and each text's number of lines, one at least."""
    lines = [t.split("\n") for t in texts]
    per = np.array([len(x) for x in lines], np.int64)
    flat = [x for doc in lines for x in doc]
    size = np.array([len(x) for x in flat], np.int64)
    points = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), "<u4")
    table = _char_classes()
    kind = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 0)
    k = len(CLASSES)
    counts = np.bincount(np.repeat(np.arange(len(flat)), size) * k + kind, minlength=k * len(flat)).reshape(-1, k)
    share = counts / np.maximum(size, 1)[:, None]
    words = np.zeros((len(flat), 3))
    again = np.zeros(len(flat))
    at = 0
    for doc in lines:
        seen: set[str] = set()
        for x in doc:
            w = x.split()
            words[at] = len(w), len(set(w)), len(set(zip(w, w[1:])))
            if x in seen and x:
                again[at] = 1
            seen.add(x)
            at += 1
    n = np.maximum(words[:, 0], 1)
    letters = counts[:, 0] + counts[:, 1]
    features = np.column_stack([
        np.minimum(share[:, [1, 2, 4, 5, 6, 7, 8, 9]] * [3, 4, 5, 8, 8, 4, 5, 5], 1.5),
        np.minimum(1, counts[:, 1] / np.maximum(letters, 1)), letters / np.maximum(size - counts[:, 3], 1),
        1 - words[:, 1] / n, np.where(n > 4, 1 - words[:, 2] / np.maximum(n - 1, 1), 0),
        np.minimum(letters / n, 20) / 10, np.log1p(size) / 6, np.log1p(words[:, 0]) / 5,
        again, size == 0, n < 4, np.where(n > 12, words[:, 1] < 0.3 * n, 0),
    ])
    return features.astype(np.float32), size, per


def with_neighbours(x: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and the line after in its text, where they exist, and ones."""
    ends = np.cumsum(per)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[ends - per], after[ends - 1] = 0, 0
    edge = np.zeros((len(x), 2), np.float32)
    edge[ends - per, 0], edge[ends - 1, 1] = 1, 1
    return np.concatenate((x, before, after, edge, np.ones((len(x), 1), np.float32)), axis=1)


def messages(u: np.ndarray, per: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with the line's own evidence) and backward log odds of "good"; ``u``: evidence, ``a``: transitions."""
    order = np.argsort(-per, kind="stable")
    start, length = (np.cumsum(per) - per)[order], per[order]
    forward, backward = u.astype(np.float64), np.zeros(len(u))
    alive = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), side="right")
    add = np.logaddexp
    for t in range(1, len(alive)):
        i = start[: alive[t]] + t
        m = forward[i - 1]
        forward[i] += add(a[0, 1], m + a[1, 1]) - add(a[0, 0], m + a[1, 0])
    for t in range(len(alive) - 1, 0, -1):
        i = start[: alive[t]] + t
        m = u[i] + backward[i]
        backward[i - 1] = add(a[1, 0], a[1, 1] + m) - add(a[0, 0], a[0, 1] + m)
    return forward, backward


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class LineField:
    """Weights of a line's evidence, transitions, and the map from the weighted mean's log odds to a score."""

    w: np.ndarray
    a: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray, size: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Log odds of each document's length-weighted mean marginal."""
        f, b = messages(x @ self.w, per, self.a)
        weight = np.maximum(size, 1).astype(np.float64)
        begin = np.cumsum(per) - per
        mean = np.add.reduceat(weight * _sigmoid(f + b), begin) / np.add.reduceat(weight, begin)
        mean = np.clip(mean, 1e-9, 1 - 1e-9)
        return np.log(mean / (1 - mean))

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, size, per = line_features(texts)
        return _sigmoid(self.scale * self.raw(with_neighbours(x, per), size, per) + self.shift)


def train(x: np.ndarray, size: np.ndarray, per: np.ndarray, label: np.ndarray, prior: float, steps: int = 250, rate: float = 0.08, decay: float = 1e-3) -> LineField:
    """Maximise the mean log likelihood per document; every line takes its document's label. The score is then
    fitted to the documents' labels with ``prior``, the share of good ones among all labelled documents."""
    x = with_neighbours(x, per)
    doc = np.repeat(np.arange(len(per)), per)
    share = max(label.mean(), 1e-6), max(1 - label.mean(), 1e-6)
    of_doc = np.where(label == 1, 0.5 / share[0], 0.5 / share[1]) / len(label)
    weight, y = of_doc[doc] / per[doc], label[doc].astype(np.float64)
    first = np.flatnonzero(doc[1:] == doc[:-1])  # lines with one after them
    w, a = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(a)]
    v = [np.zeros_like(w), np.zeros_like(a)]
    for step in range(1, steps + 1):
        u = x @ w
        f, b = messages(u, per, a)
        # marginals of neighbouring pairs
        logits = np.stack([np.zeros(len(first)) + a[0, 0], a[0, 1] + u[first + 1] + b[first + 1], f[first] + a[1, 0], f[first] + a[1, 1] + u[first + 1] + b[first + 1]])
        pair = np.exp(logits - logits.max(axis=0, initial=-np.inf)) if len(first) else logits
        pair = pair / pair.sum(axis=0) if len(first) else pair
        same = y[first] * weight[first]
        seen = np.array([[((1 - y[first]) * weight[first]).sum(), 0.0], [0.0, same.sum()]])
        grads = x.T @ (weight * (y - _sigmoid(f + b))) - decay * w, seen - (pair * weight[first]).sum(axis=1).reshape(2, 2) - decay * a
        for k, (value, g) in enumerate(zip((w, a), grads)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            value += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    field = LineField(w, a)
    raw = field.raw(x, size, per)
    # a logistic fit of the labels on the log odds, by Newton steps with a little damping
    of_doc = np.where(label == 1, prior / share[0], (1 - prior) / share[1]) / len(label)
    z, theta = np.column_stack((raw, np.ones_like(raw))), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(z @ theta)
        g = z.T @ (of_doc * (label - p)) - 1e-3 * (theta - [1.0, 0.0])
        h = (z * (of_doc * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        theta = theta + np.linalg.solve(h, g)
    field.scale, field.shift = max(float(theta[0]), 1e-3), float(theta[1])
    return field


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def train_on(docs: DataFrame, labels: DataFrame, sample: int = 4_000, lines: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> LineField:
    """Train on at most ``sample`` labelled documents, half of each label where there are enough, those with the
    smallest hashes of their ids among rows whose crc32(doc_id as text) mod 4 is not 2, on whole texts: of those, in
    that order, as many as have ``lines`` lines together. The driver holds the features of this sample alone. An id
    with several texts counts with the first by text, one with both labels not at all. Without labelled documents
    every score is 0.5.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label")).filter("_id is not null and _label in (0, 1)")
    known = known.filter(fold("_id") != 2).groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).filter("_label = _other").drop("_other")
    drawn = [known.filter(F.col("_label") == k).orderBy(F.xxhash64("_id")).limit(sample // 2) for k in (0, 1)]
    counts = dict(known.groupBy("_label").count().collect())

    def features(batches):
        for part, texts in text_batches(batches, chars=CHARS):
            x, size, per = line_features(texts)
            at = np.cumsum(per) - per
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("label"), pa.array([x[a : a + n].tobytes() for a, n in zip(at, per)], pa.binary()), pa.array([size[a : a + n].tobytes() for a, n in zip(at, per)], pa.binary())],
                ["id", "label", "x", "size"],
            )

    chosen = F.broadcast(drawn[0].union(drawn[1]))  # at most ``sample`` rows
    rows = docs.join(chosen, docs[id_col] == F.col("_id")).groupBy(F.col("_id").alias("id")).agg(F.min("_label").alias("label"), F.min(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    rows = scratch_table(rows, "sample")
    size = F.size(F.split("text", r"\n"))
    upto = F.sum(size).over(W.orderBy(F.xxhash64("id"), "id"))  # one task for at most ``sample`` rows
    within = rows.select("id", size.alias("n"), upto.alias("upto")).filter((F.col("upto") <= lines) | (F.col("upto") == F.col("n"))).select("id")
    rows = rows.join(F.broadcast(within), "id")
    got = sorted(rows.mapInArrow(features, "id long, label int, x binary, size binary").collect(), key=lambda r: (r.id, bytes(r.x)))
    if not got:
        return LineField(np.zeros(3 * N_FEATURES + 3), np.zeros((2, 2)))
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in got])
    size = np.concatenate([np.frombuffer(r.size, np.int64) for r in got])
    per = np.array([len(r.size) // 8 for r in got])
    return train(x, size, per, np.array([r.label for r in got]), counts.get(1, 0) / sum(counts.values()))


def score_documents(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of each row's whole text; null is empty, an empty text one empty
    line. Repeated rows give repeated results, an empty table an empty one; other columns are not read."""

    def run(batches):
        for part, texts in text_batches(batches, chars=CHARS):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(field.scores(texts), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(fold("doc_id") == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, field: LineField, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; all columns stay."""

    def run(batches):
        for batch in batches:
            scores = np.concatenate([np.zeros(0)] + [field.scores(texts) for _, texts in text_batches([batch], text_col, chars=CHARS)])
            yield batch.filter(pa.array(scores >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
