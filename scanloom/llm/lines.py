"""Repeated lines by sharded minimal perfect hashes.

A line's key is its text without white space at either end, A-Z lower-cased.  Keys are dealt
to shards by their 128-bit digest.  A shard numbers its distinct keys without gaps by a
minimal perfect hash (levels of bit sets; a key's number is the rank of its bit) and keeps
flat arrays by that number: a fingerprint, a document count up to ``least_docs``, and for
keys that reach it the largest doc_id.  Documents then send packed digests to the arrays,
which answer with the keys to drop; no table of lines is joined to another.

Before each shuffle a task merges its keys: towards the counts it sends at most
``least_docs`` doc_ids a key, so that a line of every document adds a few rows a task; and
the probes of a shard with many of them are dealt to several copies of its arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import textbuf as tb
from scanloom.llm.lineage import cut
from scanloom.llm.spans import KEYS, keyed, row_keys

BLANK = bytes([32, 9, 10, 11, 12, 13])
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Text bytes per shard, the least and the most shards, and the probes a copy of arrays takes.
SHARD_BYTES = 8 << 20
LEAST_SHARDS = 16
MOST_SHARDS = 1 << 20
PROBES = 1 << 18
#: Bits per key of a level of the hash, before those with a bit of their own go.
ROOM = 2
BATCH_BYTES = 32 << 20
U64 = np.uint64

RESULT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def keys(text: bytes, least_chars: int) -> Iterator[tuple[int, int, bytes | None]]:
    """Start, end and 16-byte key digest of each line; no digest for shorter keys."""
    low, at = text.translate(LOWER), 0
    while at <= len(text):
        end = text.find(b"\n", at)
        end = len(text) if end < 0 else end
        key = low[at:end].strip(BLANK)
        # UTF-8 takes one to four bytes a code point.
        long = len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode("utf-8", "replace")) >= least_chars)
        yield at, end, hashlib.blake2b(key, digest_size=16).digest() if long else None
        at = end + 1


def dealt(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (digest, row) of batches of keyed rows: an (n, 2) array, and (n, 2) row keys."""
    for batch in batches:
        buf, offs = tb.buffer(tb.column(batch, "text"))
        ids = np.stack([tb.column(batch, k).to_numpy(zero_copy_only=False) for k in KEYS], 1)
        for lo, hi in tb.groups(offs, BATCH_BYTES):
            found, owners = [], []
            for i in range(lo, hi):
                own = {d for _, _, d in keys(buf[offs[i] : offs[i + 1]].tobytes(), least_chars) if d}
                found += own
                owners += [i] * len(own)
            if found:
                yield np.frombuffer(b"".join(found), "<u8").reshape(-1, 2), ids[owners]


def by_shard(digests: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the digests of each shard that has any."""
    shard = digests[:, 0] % U64(shards)
    order = np.argsort(shard, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(shard[order]) > 0])
    for a, b in zip(at, np.r_[at[1:], len(order)], strict=True):
        yield int(shard[order[a]]), order[a:b]


def merged(digests: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """digests and distinct ids sorted by digest and from the largest id, ``most`` ids of a
    digest at most, and each one's place among its digest's."""
    order = np.lexsort((-1 - ids, digests[:, 1], digests[:, 0]))  # -1 - id turns the order without overflow
    d, i = digests[order], ids[order]
    fresh = np.r_[True, (d[1:] != d[:-1]).any(1)] if len(d) else np.zeros(0, bool)
    keep = fresh | np.r_[True, i[1:] != i[:-1]] if len(d) else fresh
    d, i, fresh = d[keep], i[keep], fresh[keep]
    place = np.arange(len(d)) - np.maximum.accumulate(np.where(fresh, np.arange(len(d)), 0)) if len(d) else np.zeros(0, np.int64)
    return d[place < most], i[place < most], place[place < most]


def _bit(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    return tb.mix(digests[:, 0] ^ tb.mix(digests[:, 1] + U64((level + 1) * tb.BASE % (1 << 64)))) % U64(size)


def perfect_hash(digests: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Bits of all levels one after the other, and the levels' sizes; digests are distinct.
    On each level the keys alone at their bit set it; the others go on to the next."""
    levels, sizes, left = [], [], digests
    while len(left):
        size = max(64, ROOM * len(left))
        bit = _bit(left, len(sizes), size)
        alone = np.bincount(bit.astype(np.int64), minlength=size) == 1
        levels.append(alone)
        sizes.append(size)
        left = left[~alone[bit]]
    return np.concatenate(levels) if levels else np.zeros(0, bool), sizes


def numbers(digests: np.ndarray, bits: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The keys' numbers; of digests that are no keys some number or -1."""
    rank = np.cumsum(bits) - 1
    out, open_, base = np.full(len(digests), -1), np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = base + _bit(digests[open_], level, size).astype(np.int64)
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        open_, base = open_[~hit], base + size
    return out


def fingerprints(digests: np.ndarray) -> np.ndarray:
    return (digests[:, 1] >> U64(32)).astype("<u4")


def arrays(digests: np.ndarray, ids: np.ndarray, least_docs: int) -> dict:
    """The hash and arrays of a shard from (digest, doc_id) pairs."""
    d, i, place = merged(digests, ids, least_docs)
    first = np.flatnonzero(place == 0)
    counts = np.diff(np.r_[first, len(d)])
    bits, sizes = perfect_hash(d[first])
    number = numbers(d[first], bits, sizes)
    prints, many, keep = np.zeros(len(first), "<u4"), np.zeros(len(first), "<u2"), np.zeros(len(first), "<i8")
    prints[number], many[number], keep[number] = fingerprints(d[first]), counts, i[first]
    return {"bits": np.packbits(bits).tobytes(), "sizes": sizes, "prints": prints.tobytes(), "counts": many.tobytes(), "keepers": keep[many >= least_docs].tobytes()}


def probe(digests: np.ndarray, ids: np.ndarray, shard: dict, least_docs: int) -> np.ndarray:
    """Whether each digest is of a key that loses its lines in the document."""
    bits = np.unpackbits(np.frombuffer(shard["bits"], np.uint8), count=sum(shard["sizes"])).astype(bool)
    prints, many, keep = (np.frombuffer(shard[c], kind) for c, kind in (("prints", "<u4"), ("counts", "<u2"), ("keepers", "<i8")))
    number = numbers(digests, bits, shard["sizes"])
    known = number >= 0
    known[known] = prints[number[known]] == fingerprints(digests[known])
    known[known] = many[number[known]] >= least_docs
    kept = np.cumsum(many >= least_docs) - 1
    known[known] = keep[kept[number[known]]] != ids[known]
    return known


def index(docs: DataFrame, shards: int, least_docs: int, least_chars: int) -> DataFrame:
    """One row a shard: its minimal perfect hash and arrays, and how many probes will come."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digests, ids in dealt(batches, least_chars):
            rows = []
            for shard, at in by_shard(digests, shards):
                d, i, _ = merged(digests[at], ids[at, 0], least_docs)
                rows.append((shard, np.column_stack([d, i.view(U64)]).tobytes(), len(at)))
            shard, pairs, load = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(pairs, pa.binary()), pa.array(load, pa.int64())], ["shard", "pairs", "load"])

    def build(key: tuple, batch: pa.Table) -> pa.Table:
        packed = np.frombuffer(b"".join(batch["pairs"].to_pylist()), "<u8").reshape(-1, 3)
        out = arrays(packed[:, :2], packed[:, 2].view(np.int64), least_docs)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "load": pa.array([sum(batch["load"].to_pylist())], pa.int64())} | {"sizes": pa.array([out.pop("sizes")], pa.list_(pa.int64()))} | {k: pa.array([v], pa.binary()) for k, v in out.items()})

    sent = docs.select("text", *KEYS).mapInArrow(deal, "shard int, pairs binary, load long")
    return sent.groupBy("shard").applyInArrow(build, "shard int, load long, sizes array<long>, bits binary, prints binary, counts binary, keepers binary")


def dropped(docs: DataFrame, index_: DataFrame, shards: int, least_docs: int, least_chars: int, probes: int) -> DataFrame:
    """The KEYS of rows and ``digests``, the keys of which they lose all lines."""
    copies = np.ones(shards, np.int32)
    for row in index_.select("shard", "load").filter(F.col("load") > probes).toLocalIterator():
        copies[row["shard"]] = -(-row["load"] // probes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digests, ids in dealt(batches, least_chars):
            rows = []
            for shard, at in by_shard(digests, shards):
                copy = int(ids[at[0], 1]) % int(copies[shard])
                rows.append((shard, copy, np.column_stack([digests[at], ids[at].view(U64)]).tobytes()))
            shard, copy, packed = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(copy, pa.int32()), pa.array(packed, pa.binary())], ["shard", "copy", "packed"])

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        shard = own.to_pylist()[0] if len(own) else None
        for value in asked["packed"] if shard else ():
            packed = np.frombuffer(value.as_py(), "<u8").reshape(-1, 4)
            out.append(packed[probe(packed[:, :2], packed[:, 2].view(np.int64), shard, least_docs)])
        rows = np.concatenate(out) if out else np.zeros((0, 4), U64)
        ids, digests = np.ascontiguousarray(rows[:, 2:]).view(np.int64), np.ascontiguousarray(rows[:, :2]).tobytes()
        return pa.table({"kid": ids[:, 0], "kh": ids[:, 1], "digest": pa.array([digests[i : i + 16] for i in range(0, len(digests), 16)], pa.binary())})

    asked = docs.select("text", *KEYS).mapInArrow(deal, "shard int, copy int, packed binary")
    numbers_ = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("load") / probes).cast("int"), F.lit(1)) - 1)
    own = index_.withColumn("copy", F.explode(numbers_))
    told = asked.groupBy("shard", "copy").cogroup(own.groupBy("shard", "copy")).applyInArrow(answer, "kid long, kh long, digest binary")
    return told.groupBy(*KEYS).agg(F.collect_set("digest").alias("digests"))


def _kept(text: bytes, gone: set[bytes], least_chars: int) -> tuple[bytes, int, int]:
    """The text without its lines of these keys, the lines there were and those dropped."""
    parts, n, lost = [], 0, 0
    for at, end, digest in keys(text, least_chars):
        n += 1
        if digest in gone:
            lost += 1
        else:
            parts.append(text[at:end])
    return b"\n".join(parts), n, lost


def _answers(docs: DataFrame, least_docs: int, least_chars: int, shard_bytes: int, probes: int) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, -(-size // shard_bytes)))
    table = cut(index(docs, shards, least_docs, least_chars), "line-arrays")
    return dropped(docs, table, shards, least_docs, least_chars, probes)


def dedup(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, shard_bytes: int = SHARD_BYTES, probes: int = PROBES) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_dropped and the SHA-256 of the lines that stay.

    Keys of ``least_chars`` code points or more that ``least_docs`` documents or more hold
    lose all their lines but those in the largest doc_id that holds them.

    A null or empty text is one empty line.  Rows that share a doc_id are one document, and
    so are all rows without one, which count below all others; each gives a row of the
    result.  Other columns are not read; an empty table gives no rows.  A text is gone
    through line by line, whatever its length.
    """
    if not 1 <= least_docs <= 65_535:
        raise ValueError("least_docs is 1 to 65,535")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tb.buffer(batch.column(1))
            rows = []
            for i in range(batch.num_rows):
                gone = set(batch.column(2)[i].as_py() or ())
                kept, n, lost = _kept(buf[offs[i] : offs[i + 1]].tobytes(), gone, least_chars)
                rows.append((n, lost, hashlib.sha256(kept).hexdigest()))
            n, lost, sha = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows = keyed(docs)
    gone = _answers(rows, least_docs, least_chars, shard_bytes, probes)
    return rows.join(gone, KEYS, "left").select("doc_id", "text", "digests").mapInArrow(run, RESULT)


def dedup_text(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, shard_bytes: int = SHARD_BYTES, probes: int = PROBES) -> DataFrame:
    """docs, all columns, their texts without the lines that dedup() drops; null stays null."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for i, gone in enumerate(batch.column(len(names)).to_pylist()):
                if gone:
                    texts[i] = _kept(texts[i].encode(), set(gone), least_chars)[0].decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if j == at else batch.column(j) for j in range(len(names))], names)

    gone = _answers(keyed(docs), least_docs, least_chars, shard_bytes, probes)
    own = ["_scanloom_kid", "_scanloom_kh"]
    renamed = gone.select(*(F.col(k).alias(o) for k, o in zip(KEYS, own, strict=True)), F.col("digests").alias("_scanloom_digests"))
    return docs.withColumns(row_keys(*own)).join(renamed, own, "left").select(*names, "_scanloom_digests").mapInArrow(run, schema)
