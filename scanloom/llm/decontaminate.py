"""Benchmark decontamination by SimHash of item-sized windows.

Every item of the benchmark has a 64-bit SimHash of its five-word shingles, weighted by
their number.  A window of as many words as an item has stands at every word of a
document; one that has fewer of its shingles in all items together than the least similarity
takes cannot be a leak, so all others get their SimHash.  A 64-bit fingerprint is eight
blocks of 8 bits; if two fingerprints differ in at most ``RADIUS`` bits, one block differs in
at most RADIUS // 8 of its bits.  Each item is listed under all such values of its blocks, so
the lists of a window's eight values have every item of its size within the radius; those
that are, and they alone, have their shingles counted.  A window and an item are a leak if
the exact weighted Jaccard similarity of the shingle multisets reaches ``PERCENT`` hundredths.

At 0.75, two fingerprints differ in 11 of 64 bits in the mean with a deviation of 3, so
that the radius of 23 is four deviations away; of unlike pairs 1.6 % are within it.

Items are taken in passes of about ``ITEMS`` and ``ITEM_BYTES`` at most, so what is broadcast
stays bounded.

Cases: null or empty texts and items match nothing; an item under five words has its
whole sequence as one shingle; a document shorter than an item has one window, all of
it; an item given twice is reported for each id; rows that share a doc_id are merged in
the report; a null doc_id is reported as null; extra columns stay unread; an empty
table on either side gives an empty report.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import textbuf as tb

RADIUS = 23
PERCENT = 75
WIDTH = 5
ITEMS = 20_000
ITEM_BYTES = 1 << 26
#: Windows whose bits are summed at a time, and pairs of a window and an item looked at at a time.
BLOCK = 1 << 16
PAIRS = 1 << 21
SCHEMA = "doc_id long, item_id long, first_word long, similarity double"


def _bit_rows(h: np.ndarray) -> np.ndarray:
    """Each hash's 64 bits as rows of 0 and 1."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)


def simhash(h: np.ndarray) -> int:
    """Bit by bit, whether more than half of the shingles have it set."""
    return int(np.packbits(2 * _bit_rows(h).sum(0, dtype=np.int64) > len(h)).view(np.uint64)[0])


@dataclass
class Item:
    item_id: int
    n_words: int
    sorted_hashes: np.ndarray
    fingerprint: int


def read_items(benchmark: DataFrame, number: int, passes: int) -> list[Item]:
    """The items of one pass, at most about ITEMS."""
    rows = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).select("item_id", "text").collect()
    out = []
    for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0)):
        h, at = tb.words(*tb.buffer(pa.array([r["text"]], pa.string())))
        s, _ = tb.shingles(h, at, WIDTH)
        if len(s):
            out.append(Item(r["item_id"], len(h), np.sort(s), simhash(s)))
    return out


class Index:
    """By number of words: block tables over the fingerprints of the items."""

    def __init__(self, items: list[Item], radius: int = RADIUS):
        self.radius = radius
        self.sizes: dict[int, list[Item]] = {}
        for x in items:
            self.sizes.setdefault(x.n_words, []).append(x)
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x.sorted_hashes for x in items)]))
        self.low = np.uint64((1 << max(16, (16 * len(self.known)).bit_length())) - 1)
        self.maybe = np.zeros(int(self.low) + 1, bool)
        self.maybe[self.known & self.low] = True
        self.prints = {n: np.array([x.fingerprint for x in xs], np.uint64) for n, xs in self.sizes.items()}
        #: By number of words, the items listed under each of the 256 values of each block,
        #: one list after the other, and where each begins.
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        near = np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) <= radius // 8).astype(np.uint8)
        for n, prints in self.prints.items():
            values = (prints.view(np.uint8).reshape(-1, 8, 1) ^ near).astype(np.int64) + 256 * np.arange(8)[:, None]
            place, item = values.reshape(-1), np.repeat(np.arange(len(prints)), 8 * len(near))
            order = np.argsort(place, kind="stable")
            self.lists[n] = item[order], np.searchsorted(place[order], np.arange(8 * 256 + 1))

    def in_any(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles some item has."""
        out = self.maybe[shingles & self.low]
        some = np.flatnonzero(out)
        if len(some):
            out[some] = self.known[np.minimum(np.searchsorted(self.known, shingles[some]), len(self.known) - 1)] == shingles[some]
        return out

    def candidates(self, n: int, prints: np.ndarray) -> Iterator[tuple[np.ndarray, Item]]:
        """(windows, item) for all of the fingerprints and the items of n words within the
        radius of each other."""
        items, starts = self.lists[n]
        step = max(1, PAIRS // (2 * len(self.sizes[n])))
        by_item: dict[int, list] = {}
        for lo in range(0, len(prints), step):
            part = np.ascontiguousarray(prints[lo : lo + step])
            values = (part.view(np.uint8).reshape(-1, 8) + 256 * np.arange(8)).reshape(-1)
            many = starts[values + 1] - starts[values]
            listed = items[np.repeat(starts[values] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            window = np.repeat(np.repeat(np.arange(len(part)), 8), many)
            within = np.bitwise_count(part[window] ^ self.prints[n][listed]) <= self.radius
            pairs = np.unique(listed[within] * len(part) + window[within])
            found, window = np.divmod(pairs, len(part))
            for i in np.unique(found).tolist():
                by_item.setdefault(i, []).append(lo + window[found == i])
        for i, windows in by_item.items():
            yield np.concatenate(windows), self.sizes[n][i]


_held: dict[str, Index] = {}


def _index(token: str, sent: Broadcast, radius: int) -> Index:
    """The index of a pass, built once a worker, which holds no other."""
    if token not in _held:
        _held.clear()
        _held[token] = Index(sent.value, radius)
    return _held[token]


def weighted_similarity(sorted_a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser over the sum of the larger counts of two shingle multisets."""
    ua, ca = np.unique(sorted_a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[ia], cb[ib]).sum())
    return common / (len(sorted_a) + len(b) - common)


def _prints(part: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows first..last of shingles: more than half of them."""
    total = np.zeros((len(part) + 1, 64), np.int32)
    np.cumsum(_bit_rows(part), axis=0, dtype=np.int32, out=total[1:])
    return np.packbits((2 * (total[last] - total[first]) > (last - first)[:, None]).reshape(-1)).view(np.uint64)


def leaks_of(words: np.ndarray, offs: np.ndarray, index: Index, percent: int) -> dict[tuple[int, int], tuple[float, int, int]]:
    """Of some texts' words: best similarity, first word and item by (text, item)."""
    found: dict = {}
    s, at = tb.shingles(words, offs, WIDTH)
    if not len(s) or not index.sizes:
        return found
    shared = np.concatenate([[0], np.cumsum(index.in_any(s))])
    n_s = {size: max(1, size - WIDTH + 1) for size in index.sizes}
    begin, end = np.repeat(at[:-1], np.diff(at)), np.repeat(at[1:], np.diff(at))

    def enough(count: np.ndarray, n: int) -> np.ndarray:
        return 100 * count >= percent * n - 1e-9

    def look(size: int, first: np.ndarray, last: np.ndarray) -> None:
        """Windows near each other, in order, of which any could be a leak."""
        lo = int(first[0])
        part = s[lo : int(last.max())]
        prints = _prints(part, first - lo, last - lo)
        for near, item in index.candidates(size, prints):
            place = np.minimum(np.searchsorted(item.sorted_hashes, part), len(item.sorted_hashes) - 1)
            common = np.concatenate([[0], np.cumsum(item.sorted_hashes[place] == part)])
            near = near[enough(common[last[near] - lo] - common[first[near] - lo], len(item.sorted_hashes))]
            for start, stop in zip(first[near].tolist(), last[near].tolist(), strict=True):
                text = int(np.searchsorted(at, start, side="right")) - 1
                best = found.get((text, id(item)), (0,))[0]
                if best < 1:
                    similarity = weighted_similarity(item.sorted_hashes, s[start:stop])
                    if 100 * similarity >= percent - 1e-9 and similarity > best:
                        found[text, id(item)] = (similarity, int(start - at[text]), item.item_id)

    # Places from which the longest window has what the shortest one needs.
    maybe = np.flatnonzero(enough(shared[np.minimum(np.arange(len(s)) + max(n_s.values()), end)] - shared[:-1], min(n_s.values())))
    begin, end = begin[maybe], end[maybe]
    for size, n in n_s.items():
        last = np.minimum(maybe + n, end)
        # A text shorter than the item has one window, all of it.
        ok = enough(shared[last] - shared[maybe], n) & ((last - maybe == n) | (maybe == begin))
        first, last = maybe[ok], last[ok]
        cuts = np.flatnonzero(np.diff(first) > n) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(first)], strict=True):
            for k in range(lo, hi, BLOCK):
                look(size, first[k : min(hi, k + BLOCK)], last[k : min(hi, k + BLOCK)])
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, first_word, similarity), the best place of each item leaked."""
    spark = docs.sparkSession
    size = benchmark.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    passes = max(1, math.ceil(size["n"] / ITEMS), math.ceil(size["bytes"] / ITEM_BYTES))

    def one_pass(number: int) -> DataFrame:
        sent, token = spark.sparkContext.broadcast(read_items(benchmark, number, passes)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(token, sent, radius)
            for batch in batches:
                buf, offs = tb.buffer(batch.column(1))
                ids, out = batch.column(0).to_pylist(), []
                for lo, hi in tb.groups(offs, 1 << 20):
                    h, at = tb.words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                    out += [(ids[lo + text], item, first, sim) for (text, _), (sim, first, item) in leaks_of(h, at, index, percent).items()]
                cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "first_word", "similarity"])

        return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

    rows = reduce(DataFrame.union, map(one_pass, range(passes)))
    best = F.max_by(F.struct("first_word", "similarity"), F.struct("similarity", -F.col("first_word"))).alias("x")
    return rows.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.first_word", "x.similarity")
