"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes; a chunk ends where the hash is the least within
``REACH`` bytes to either side, which depends on the bytes around it alone: after an
insertion the boundaries fall into step again at once.  No chunk is shorter than
REACH + 1 bytes but a text's last one; stretches without a boundary (runs of one byte) are
cut every ``LONGEST`` bytes.  Chunks are known by a 128-bit BLAKE2 digest; of equal chunks
the first by (doc_id, place) stays and the others go, if they are in a run of such chunks
of at least ``LEAST`` bytes (a short phrase by itself is no repeat).

Cases: null and empty texts have no chunks; a text's own repeats count; rows equal in
doc_id and text count as one document and give as many rows; a null doc_id sorts first;
extra columns stay unread; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import textbuf as tb
from scanloom.llm.lineage import cut, drop
from scanloom.llm.spans import KEYS, keyed, remove, remove_text

REACH = 28
LEAST = 96
LONGEST = 1024
SEEN = "d1 long, d2 long, kid long, kh long, start int, length int"
#: Bytes that a 32-bit gear hash spans: older ones have been shifted out.
GEAR_SPAN = 32
#: Bytes hashed at a time.
BLOCK = 1 << 21


def gear_table() -> np.ndarray:
    return (tb.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(32)).astype(np.uint32)


def gear(buf: np.ndarray) -> np.ndarray:
    """The rolling hash h = 2 * h + gear[byte] modulo 2**32 at each byte."""
    h = gear_table()[buf]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def least_ahead(h: np.ndarray, n: int) -> np.ndarray:
    """At each place the least of the n values from it on (fewer at the end)."""
    out, have = h.copy(), 1
    while have < n:
        step = min(have, n - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def boundaries(buf: np.ndarray, offs: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Chunk ends (excluding the texts' own) in a buffer of texts."""
    start = offs[:-1][np.diff(offs) > 0]
    pad = np.full(reach, 1 << 33, np.uint64)
    found = [np.zeros(0, np.int64)]
    for lo in range(0, len(buf), BLOCK):
        hi = min(lo + BLOCK, len(buf))
        # What a place is judged by reaches so far on either side.
        a, b = max(0, lo - GEAR_SPAN - reach), min(len(buf), hi + reach)
        h = gear(buf[a:b]).astype(np.uint64)
        # A text's first bytes, whose hash would span the text before, can't be boundaries.
        near = start[np.searchsorted(start, a - GEAR_SPAN) : np.searchsorted(start, b)]
        early = (near[:, None] + np.arange(GEAR_SPAN - 1) - a).reshape(-1)
        h[early[(early >= 0) & (early < b - a)]] = 1 << 33
        ahead = least_ahead(np.concatenate([h[1:], pad, pad[:1]]), reach)[: len(h)]
        behind = least_ahead(np.concatenate([pad, h]), reach)[: len(h)]
        at = np.flatnonzero((h < behind) & (h <= ahead) & (h < 1 << 33)) + a
        found.append(at[(at >= lo) & (at < hi)] + 1)
    return np.concatenate(found)


def chunk_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all chunks of all texts."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.unique(np.concatenate([boundaries(buf, offs), offs[1:][np.diff(offs) > 0]]))
    starts = np.concatenate([[0], ends[:-1]])
    parts = -(-(ends - starts) // LONGEST)
    of = np.repeat(np.arange(len(ends)), parts)
    number = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    s = starts[of] + number * LONGEST
    return s, np.minimum(s + LONGEST, ends[of])


def seen_chunks(docs: DataFrame) -> DataFrame:
    """Every chunk of keyed docs with its digest and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tb.buffer(batch.column(0))
            ids, hashes = batch.column(1), batch.column(2)
            for lo, hi in tb.groups(offs, 1 << 21):
                part, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                s, e = chunk_spans(part, o)
                raw = part.tobytes()
                d = np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(s.tolist(), e.tolist(), strict=True)]), np.int64).reshape(-1, 2)
                text = np.searchsorted(o, s, side="right") - 1
                at = pa.array(lo + text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[:, 0]), pa.array(d[:, 1]), ids.take(at), hashes.take(at), pa.array((s - o[text]).astype(np.int32)), pa.array((e - s).astype(np.int32))],
                    ["d1", "d2", *KEYS, "start", "length"],
                )

    return docs.select("text", *KEYS).mapInArrow(run, SEEN)


def repeats(docs: DataFrame) -> DataFrame:
    """KEYS and ``at`` (starts and ends in turn) of the later ones of equal chunks."""
    seen = cut(seen_chunks(docs), "chunks")
    where = F.struct(*KEYS, "start")
    # Written: a join with an aggregate on the same key could not be split where a chunk is very common.
    often = cut(seen.groupBy("d1", "d2").agg(F.min(where).alias("first"), F.count("*").alias("n")).filter("n > 1").select("d1", "d2", "first"), "common-chunks")
    extra = seen.join(often, ["d1", "d2"]).filter(where != F.col("first"))
    spans = cut(extra.groupBy(*KEYS).agg(F.flatten(F.collect_list(F.array("start", F.col("start") + F.col("length")))).alias("at")), "chunk-spans")
    drop(seen)
    drop(often)
    return spans


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (runs of removed chunks) and the
    SHA-256 of what is left."""
    docs = keyed(docs)
    return remove(docs, repeats(docs), least)


def dedup_text(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs, all columns, without the removed chunks in their texts."""
    return remove_text(docs, repeats(keyed(docs)), least)
