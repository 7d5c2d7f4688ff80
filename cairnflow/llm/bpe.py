"""Byte-pair encoding and decoding over a pair occurrence index (``tokens.PairIndexBpe``).

Each batch of documents puts the stretches that its worker has not met yet into one index, so a frequent
pair is merged once for all its positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.tokens import word_documents, word_tokenizer

#: Rows tokenised at a time, and characters after which a batch ends early.
ROWS, CHARS = 4_000, 12_000_000


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = ROWS, chars: int = CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of bounded size with their texts; null is empty."""
    for batch in batches:
        at = 0
        sizes = [0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()]
        while at < batch.num_rows:
            end, total = at, 0
            while end < batch.num_rows and end - at < rows and (end == at or total + sizes[end] <= chars):
                total += sizes[end]
                end += 1
            part = batch.slice(at, end - at)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            at = end


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row, whole texts, null as empty; equal to the tokenizers library's
    encode without added special tokens. Repeated rows give repeated results; other columns are not read."""

    def run(batches):
        for part, texts in text_batches(batches):
            ids, bounds = word_documents(tokenizer, texts)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids): the tokens' strings with one space between, as the library's decode
    does for a file without a decoder. Null ids decode to an empty text; unknown ids are left out."""

    def run(batches):
        token = word_tokenizer(tokenizer).token
        for batch in batches:
            texts = [" ".join([token[i] for i in ids or () if i in token]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encode, then decode, in one pass over whole texts.

    Null and empty texts have no tokens and the digests of the empty string. An empty table gives an empty result.
    """

    def run(batches):
        token = word_tokenizer(tokenizer).token
        shown = pa.array([token.get(i, "") for i in range(max(token) + 1)])
        number = pa.array([str(i) for i in range(max(token) + 1)])
        for part, texts in text_batches(batches):
            ids, bounds = word_documents(tokenizer, texts)
            rows = []
            for a, b in zip(bounds.tolist(), bounds.tolist()[1:]):
                own = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), pa.array(ids[a:b]))
                parts = [pc.binary_join(pa.ListArray.from_arrays(own.offsets, x.take(own.values)), " ")[0].as_buffer() for x in (number, shown)]
                rows.append((b - a, *(hashlib.sha256(x).hexdigest() for x in parts)))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
