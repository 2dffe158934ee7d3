"""Cutting byte spans out of texts, shared by the two repeat removers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import textbuf as tb

CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


#: Columns that tell rows apart: doc_id (null: the least number) and a hash of the text.
KEYS = ["kid", "kh"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the KEYS, which equal rows share."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumns(row_keys(*KEYS))


def row_keys(kid: str, kh: str) -> dict:
    return {kid: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), kh: F.xxhash64(F.coalesce("text", F.lit("")))}


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal disjoint ones."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:] - 1, len(s) - 1)] if len(s) else e


def _cut(text: np.ndarray, lists: pa.ListScalar, least: int) -> tuple[bytes, int]:
    """What is left of a text, and the number of spans cut out."""
    at = lists.values.to_numpy() if lists.is_valid else np.zeros(0, np.int32)
    s, e = merged(at[::2].astype(np.int64), at[1::2].astype(np.int64))
    go = (e - s >= least) | (e - s == len(text))
    s, e = s[go], e[go]
    if not len(s):
        return text.tobytes(), 0
    bounds = np.concatenate([[0], np.stack([s, e], 1).reshape(-1), [len(text)]])
    return b"".join(text[a:b].tobytes() for a, b in bounds.reshape(-1, 2)), len(s)


def remove(docs: DataFrame, spans: DataFrame, least: int = 1) -> DataFrame:
    """Counts and the SHA-256 of each row of keyed docs without the bytes of its spans.

    spans has the KEYS and ``at``, an array of starts and ends in turn; touching spans count
    as one, and one under ``least`` bytes stays unless it is the whole text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tb.buffer(batch.column(1))
            rows = []
            for i in range(batch.num_rows):
                kept, n = _cut(buf[offs[i] : offs[i + 1]], batch.column(2)[i], least)
                size = int(offs[i + 1] - offs[i])
                rows.append((size, size - len(kept), n, hashlib.sha256(kept).hexdigest()))
            n = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in n[:3]), pa.array(n[3], pa.string())], [x.split()[0] for x in CUT.split(", ")])

    return docs.join(spans, KEYS, "left").select("doc_id", "text", "at").mapInArrow(run, CUT)


def remove_text(docs: DataFrame, spans: DataFrame, least: int = 1) -> DataFrame:
    """docs, all columns, with their texts cut as in remove(); of a character that a span
    cuts through, the rest goes too.  Texts without spans, null ones too, stay as they are."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            buf, offs = tb.buffer(batch.column(at))
            lists = batch.column(batch.num_columns - 1)
            texts = [_cut(buf[offs[i] : offs[i + 1]], lists[i], least)[0].decode("utf-8", "ignore") if lists[i].is_valid else batch.column(at)[i].as_py() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if j == at else batch.column(j) for j in range(len(names))], names)

    own = ["_scanloom_kid", "_scanloom_kh"]
    joined = docs.withColumns(row_keys(*own)).join(spans.select(*(F.col(k).alias(o) for k, o in zip(KEYS, own, strict=True)), F.col("at").alias("_scanloom_at")), own, "left")
    return joined.select(*names, "_scanloom_at").mapInArrow(run, docs.schema)
