"""Whole texts as flat byte buffers, and vectorised word hashing over them.

Every operator of this subpackage that reads text gets it as Arrow batches inside
Spark tasks.  This module turns a batch into one ``uint8`` array plus offsets (no
Python string per row) and offers the few vectorised steps the operators share:
A-Z lower-casing, splitting into words ``[^\\x20\\x09-\\x0D]+``, a 64-bit hash for
each word and for each run of five words.  Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the polynomial word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes hashed at a time; bounds the 8-byte temporaries whatever a text's length.
BLOCK = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=U64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes, or bytes as they are, and its len+1 offsets into them; null
    is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    binary = pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)
    col = col.cast(pa.large_binary() if binary else pa.large_string())
    if col.null_count:
        col = col.fill_null(b"" if binary else "")
    _, offs, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def groups(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows lo..hi whose bytes stay within limit (a longer row goes alone)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def blocks(buf: np.ndarray, offs: np.ndarray, limit: int, lap: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As groups(): first row, place in it, bytes and offsets; a row of more than limit + lap
    bytes comes in blocks of them, each of which starts limit bytes after the one before."""
    for lo, hi in groups(offs, limit + lap):
        a, b = int(offs[lo]), int(offs[hi])
        if b - a <= limit + lap:
            yield lo, 0, buf[a:b], offs[lo : hi + 1] - a
            continue
        for at in range(0, b - a - lap, limit):
            part = buf[a + at : min(b, a + at + limit + lap)]
            yield lo, at, part, np.array([0, len(part)])


def lower(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a word never crosses from one text into the next."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z
    solid = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.empty(len(buf), bool)
    edge[0] = solid[0]
    edge[1:] = solid[1:] & ~solid[:-1]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    edge[inner] = solid[inner]
    stop = np.empty(len(buf), bool)
    stop[-1] = solid[-1]
    stop[:-1] = solid[:-1] & ~solid[1:]
    stop[inner - 1] = solid[inner - 1]
    return np.flatnonzero(edge), np.flatnonzero(stop) + 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; spans are in order and do not overlap."""
    out = np.empty(len(starts), U64)
    lo = 0
    while lo < len(starts):
        first = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, first + BLOCK, side="right")))
        last = int(ends[hi - 1])
        part = buf[first:last].astype(U64) + U64(1)
        total = np.empty(len(part) + 1, U64)
        total[0] = 0
        np.cumsum(part * _power_table("up", BASE, len(part))[: len(part)], out=total[1:])
        s, e = starts[lo:hi] - first, ends[lo:hi] - first
        down = _power_table("down", BASE_INV, len(part) + 1)
        out[lo:hi] = mix((total[e] - total[s]) * down[s])
        lo = hi
    return out


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and per text the len+1 offsets into them."""
    low = lower(buf)
    starts, ends = word_spans(low, offs)
    return span_hashes(low, starts, ends), np.searchsorted(starts, offs)


def shingles(h: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words by text, and per text the offsets into them.

    A text with fewer words has its whole sequence as one; without words it has none.
    """
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    offs = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    first = np.repeat(at[:-1] - offs[:-1], count) + np.arange(offs[-1])
    length = np.repeat(np.minimum(n, width), count)
    out = np.zeros(offs[-1], U64)
    padded = np.concatenate([h, np.zeros(width, U64)])
    for j in range(width):
        step = (out + padded[first + j]) * U64(0xD6E8FEB86659FD93)
        step = step ^ (step >> U64(32))
        out = np.where(j < length, step, out)
    return mix(out + length.astype(U64)), offs
