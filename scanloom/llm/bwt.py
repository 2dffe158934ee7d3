"""Suffix-array dedup: repeated 200-byte strings by merging Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too.
Three steps keep the work in proportion and each task's share bounded:

1. The strings (windows) of a text are dealt by content: each goes with the least hash
   of the ``GRAM``-byte strings in it.  Equal windows agree in that anchor.  Neighbouring
   windows with one anchor form a stretch of text; a row holds the anchor, a hash of the
   whole stretch and its place.  Stretches whose anchor occurs once have no repeats.
2. Of equal stretches all windows repeat.  One of each remaining kind, if its anchor has
   several kinds (the ends of repeats, so few), goes with the text around it to the
   anchor's task.
3. There, stretches form shards.  Each shard's suffixes are sorted once, which gives
   its Burrows-Wheeler transform; the transforms are merged by iterative interleave
   refinement: from the interleave that is right for h symbols, one stable pass over
   the symbols before each suffix gives that for h + 1, and where neighbours first part
   is their common prefix.  No suffix of two shards is compared or sorted again.  After
   LENGTH bytes, intervals of more than one suffix are the repeated windows.  Symbols are
   eight bytes wide (a text is then eight strings, by offset), so 25 passes do.

An anchor with more than ``HOT`` kinds of stretches or ``HOT_BYTES`` of them would be one
task's.  Its kinds go through the three steps again as texts of their own, dealt by longer
anchors (four fifths of the way to LENGTH), so that the windows of a frequent passage fall
into stretches that are equal and those at its borders apart.  What still has so many kinds
is dealt by the windows themselves, of which equal ones repeat.  Stretches are taken as
equal if their anchors, hashes and lengths agree (two hashes of 64 bits), such windows if
their anchors and hashes do.

Cases: null and empty texts and those under LENGTH bytes lose nothing; a text's own
repeats count, overlapping ones too; rows equal in doc_id and text are copies of each
other like any others; a null doc_id is a document; extra columns stay unread; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import textbuf as tb
from scanloom.llm.chunks import least_ahead
from scanloom.llm.lineage import cut, drop
from scanloom.llm.spans import KEYS, keyed, merged, remove, remove_text

LENGTH = 200
GRAM = 80
#: Windows in a stretch at most; a longer one (periodic text) is cut, windows stay whole.
STRETCH = 4096
#: Windows of a text hashed at a time; a stretch ends with its block, windows stay whole.
BLOCK = 1 << 20
HOT = 1000
HOT_BYTES = 1 << 21
SHARD_BYTES = 1 << 14
MERGE_BYTES = 1 << 16
SYMBOL = 8
STRETCHES = "anchor long, whole long, kid long, kh long, at long"


def _sums(buf: np.ndarray) -> np.ndarray:
    up = tb._power_table("up", tb.BASE, len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return total


def _hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    down = tb._power_table("down", tb.BASE_INV, len(total))
    return tb.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def grams(buf: np.ndarray, length: int) -> np.ndarray:
    """Hash of each string of that length in buf."""
    total = _sums(buf)
    n = len(buf) - length + 1
    down = tb._power_table("down", tb.BASE_INV, len(total))
    return tb.mix((total[length:] - total[:n]) * down[:n] + np.uint64(length))


def _of_texts(buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, hash of the stretch, first window, windows, inner) per stretch."""
    n = np.diff(offs)
    if len(buf) < length or not (n >= length).any():
        z = np.zeros(0, np.int64)
        return z, z.view(np.uint64), z.view(np.uint64), z, z, z
    h = grams(buf, gram)
    anchor = least_ahead(h, length - gram + 1)[: len(buf) - length + 1]
    valid = np.zeros(len(buf) + 1, np.int32)
    have = n >= length
    np.add.at(valid, offs[:-1][have], 1)
    np.add.at(valid, offs[1:][have] - length + 1, -1)
    valid = np.cumsum(valid[: len(anchor)]) > 0
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    new[np.minimum(offs[:-1][have], len(anchor) - 1)] = True
    first = np.flatnonzero(new)
    stop = np.flatnonzero(valid & ~np.append(valid[1:] & ~new[1:], False)) + 1
    parts = -(-(stop - first) // STRETCH)
    of = np.repeat(np.arange(len(first)), parts)
    number = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    first, stop = first[of] + number * STRETCH, np.minimum(first[of] + (number + 1) * STRETCH, stop[of])
    total = _sums(buf)
    whole = _hashes(total, first, stop + length - 1)
    text = np.searchsorted(offs, first, side="right") - 1
    return text, anchor[first], whole, first - offs[text], stop - first, _twice(h, anchor, first, stop, length - gram)


def _twice(h: np.ndarray, anchor: np.ndarray, first: np.ndarray, stop: np.ndarray, reach: int) -> np.ndarray:
    """1 where the anchor's hash is met twice in a stretch (periodic text), else 0."""
    # The last place of the least value in each stretch against the first one.
    size = stop - first + reach
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    same = h[at] == np.repeat(anchor[first], size)
    return (np.add.reduceat(same, np.cumsum(size) - size, dtype=np.int64) > 1).astype(np.int64)


def find_stretches(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The stretches of keyed docs; ``at`` packs first window, windows and inner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tb.buffer(batch.column(0))
            for lo, place, part, o in tb.blocks(buf, offs, BLOCK, length - 1):
                text, anchor, whole, first, count, inner = _of_texts(part, o, length, gram)
                at = ((place + first) << 20) | (count << 1) | inner
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), *(batch.column(i).take(pa.array(lo + text)) for i in (1, 2)), pa.array(at)], ["anchor", "whole", *KEYS, "at"])

    return docs.select("text", *KEYS).mapInArrow(run, STRETCHES)


class Shard:
    """Some byte strings, all their suffixes in order, and the symbol before each."""

    def __init__(self, strings: list[np.ndarray], codes: np.ndarray):
        lengths = np.array([len(s) for s in strings])
        base = np.concatenate([[0], np.cumsum(lengths + 1)])  # len - 7 symbols and 8 ends
        n = int(base[-1])
        symbol = np.zeros(n, np.int64)
        is_end = np.zeros(n, bool)
        for s, b in zip(strings, base, strict=False):
            symbol[b : b + len(s) - SYMBOL + 1] = np.searchsorted(codes, words_of(s)) + 1
            is_end[b + len(s) - SYMBOL + 1 : b + len(s) + 1] = True
        ends = np.flatnonzero(is_end)
        # Ends are all different and sort first, in the order of the strings.
        rank = symbol + len(ends)
        rank[ends] = np.arange(len(ends))
        step, follow = SYMBOL, np.arange(n)
        while True:
            ahead = np.minimum(follow + step, n - 1)
            pair = rank * (n + len(codes) + 2) + np.where(rank < len(ends), 0, rank[ahead] + 1)
            order = np.argsort(pair, kind="stable")
            new = np.ones(n, np.int64)
            new[1:] = pair[order][1:] != pair[order][:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            if new.all():
                break
            step *= 2
        self.order, self.ends = order, len(ends)
        string = np.repeat(np.arange(len(strings)), lengths + 1)
        place = order - base[string[order]]
        self.before = np.where(place >= SYMBOL, symbol[np.maximum(order - SYMBOL, 0)], 0)
        self.back = np.where(place >= SYMBOL, rank[np.maximum(order - SYMBOL, 0)], 0)
        self.string, self.place = string[order], place


def words_of(s: np.ndarray) -> np.ndarray:
    """Each run of SYMBOL bytes as a big-endian number."""
    m = len(s) - SYMBOL + 1
    out = np.zeros(m, np.uint64)
    for j in range(SYMBOL):
        out = (out << np.uint64(8)) | s[j : m + j]
    return out


def merge(shards: list[Shard], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes (numbered through the shards, each in its own
    order), and where in it suffixes part from the one before within ``passes`` symbols."""
    base = np.concatenate([[0], np.cumsum([len(s.order) for s in shards])]).astype(np.int32)
    most = max((int(s.before.max()) for s in shards), default=0)
    before = np.concatenate([s.before for s in shards]).astype(np.uint16 if most < 1 << 16 else np.uint32)
    back = np.concatenate([s.back + b for s, b in zip(shards, base, strict=False)]).astype(np.int32)
    ends = np.concatenate([np.arange(b, b + s.ends, dtype=np.int32) for s, b in zip(shards, base, strict=False)])
    now = np.arange(base[-1], dtype=np.int32)
    part = np.zeros(len(now), bool)
    part[:1] = True
    for _ in range(passes):
        symbols = before[now]
        go = np.flatnonzero(symbols)  # no symbol before a string's first suffixes
        symbols = symbols[go]
        order = np.argsort(symbols, kind="stable")
        c, b = symbols[order], np.cumsum(part, dtype=np.int32)[go][order]
        part = np.ones(len(now), bool)
        np.not_equal(c[1:], c[:-1], out=part[len(ends) + 1 :])
        part[len(ends) + 1 :] |= b[1:] != b[:-1]
        # A shard keeps its own order: the suffix one symbol longer is known by its number.
        now = np.concatenate([ends, back[now[go][order]]])
    return now, part


def repeated_windows(strings: list[np.ndarray], length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each string the starts of its windows that start somewhere else as well."""
    if not strings:
        return []
    codes = np.unique(np.concatenate([words_of(s) for s in strings]))
    shards, names, now, size = [], [], [], 0
    for i, s in enumerate(strings):
        now.append(i)
        size += len(s)
        if size >= shard_bytes or i == len(strings) - 1:
            shards.append(Shard([strings[j] for j in now], codes))
            names.append(np.array(now))
            now, size = [], 0
    now, part = merge(shards, length // SYMBOL)
    alone = part & np.append(part[1:], True)
    string = np.concatenate([n[s.string] for n, s in zip(names, shards, strict=True)])[now]
    place = np.concatenate([s.place for s in shards])[now]
    lengths = np.array([len(s) for s in strings])
    hit = np.flatnonzero(~alone & (place <= lengths[string] - length))
    string, place = string[hit], place[hit]
    order = np.lexsort((place, string))
    cuts = np.searchsorted(string[order], np.arange(len(strings) + 1))
    return [place[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _spans(starts: np.ndarray, length: int) -> list[int]:
    s, e = merged(starts.astype(np.int64), starts.astype(np.int64) + length)
    return np.stack([s, e], 1).reshape(-1).tolist()


#: Equal stretches agree in these.
KIND = ["anchor", "whole", "windows"]


def judged(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(anchor, whole, windows, rel): starts and ends of the repeats in stretches (anchor,
    whole, windows, known, part) sorted by anchor, but for those known to repeat as a whole.
    Anchors are merged one after another, about MERGE_BYTES at a time."""

    def judge(table: pa.Table) -> pa.RecordBatch:
        anchor, whole, windows, known = (tb.column(table, c).to_numpy() for c in (*KIND, "known"))
        strings = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("part")]
        got = repeated_windows(strings, length)
        at = [i for i, x in enumerate(got) if len(x) and not known[i]]
        return pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in (anchor, whole, windows)), pa.array([_spans(got[i], length) for i in at], pa.list_(pa.int32()))], [*KIND, "rel"])

    held, size, wait = [], 0, MERGE_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += tb.column(batch, "part").nbytes
        if size >= wait:
            table = pa.Table.from_batches(held)
            anchor = tb.column(table, "anchor").to_numpy()
            lo, ends = 0, np.cumsum([len(x.as_buffer()) for x in table.column("part")])
            last = int(np.searchsorted(anchor, anchor[-1]))
            while lo < last:  # all stretches of an anchor are in one merge
                hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MERGE_BYTES)) + 1
                hi = min(last, int(np.searchsorted(anchor, anchor[min(hi, last) - 1], side="right")))
                yield judge(table.slice(lo, hi - lo))
                lo = hi
            held = table.slice(last).to_batches()
            size = int(ends[-1] - (ends[last - 1] if last else 0))
            wait = max(MERGE_BYTES, 2 * size)
    if held:
        table = pa.Table.from_batches(held)
        yield judge(table)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, hot_bytes: int = HOT_BYTES, again: bool = True) -> DataFrame:
    """KEYS and ``at`` (starts and ends in turn) of the repeated bytes of keyed docs; frequent
    anchors' kinds are dealt ``again`` by longer anchors, or else by their windows."""
    if length % SYMBOL or not SYMBOL < gram < length:
        raise ValueError(f"length must be a multiple of {SYMBOL} and gram shorter")
    every = cut(find_stretches(docs, length, gram), "stretches")
    inner = F.col("at").bitwiseAND(1)
    windows = F.shiftright(F.col("at").bitwiseAND(0xFFFFF), 1).cast("int")
    several = every.groupBy("anchor").agg(F.count("*").alias("n"), F.max(inner).alias("inner")).filter("n > 1 or inner = 1").select("anchor")
    # Written, so that a join by a frequent anchor has nothing but rows on either side and
    # Spark can split it.
    several = cut(several, "several-anchors")
    found = cut(every.join(several, "anchor", "left_semi").withColumn("windows", windows), "repeated-anchors")
    drop(every)
    drop(several)
    kinds = found.groupBy(*KIND).agg(F.count("*").alias("n"), F.max(inner).alias("inner"), F.min(F.struct(*KEYS, "at")).alias("one"))
    kinds = cut(kinds, "kinds")
    # Written for the same reason.
    per = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("windows") + (length - 1)).alias("bytes"), F.max("inner").alias("any_inner")).filter("kinds > 1 or any_inner = 1")
    per = cut(per.select("anchor", ((F.col("kinds") > hot) | (F.col("bytes") > hot_bytes)).alias("hot")), "anchors")
    ends = kinds.join(per, "anchor").select(*KIND, "hot", (F.col("n") > 1).alias("known"), *(F.col(f"one.{c}").alias(c) for c in (*KEYS, "at")))
    wanted = ends.groupBy(*KEYS).agg(F.collect_list(F.struct(*KIND, "hot", "known", "at")).alias("wanted"))
    one_each = docs.select(*KEYS, "text").join(wanted, KEYS).dropDuplicates(KEYS)
    fetched = "anchor long, whole long, windows int, hot boolean, known boolean, part binary"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in fetched.split(", ")]
        for batch in batches:
            buf, offs = tb.buffer(batch.column(0))
            lists = batch.column(1)
            for i in range(batch.num_rows):
                text = buf[offs[i] : offs[i + 1]]
                w = lists[i].values
                first, count = w.field("at").to_numpy() >> 20, w.field("windows").to_numpy()
                parts = [text[a : a + n + length - 1].tobytes() for a, n in zip(first.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(w.field(x) for x in names[:-1]), pa.array(parts, pa.binary())], names)

    parts = cut(one_each.select("text", "wanted").mapInArrow(fetch, fetched), "ends")
    rel = "anchor long, whole long, windows int, rel array<int>"
    cold = parts.filter("not hot").select(*KIND, "known", "part").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda batches: judged(batches, length), rel)

    marks = kinds.filter("n > 1").select(*KIND, F.lit(None).cast("array<int>").alias("rel")).unionByName(cold)
    frequent = parts.filter("hot")
    if not frequent.isEmpty():
        marks = marks.unionByName(dealt_again(frequent, length, gram, hot, hot_bytes) if again else of_windows(frequent, length))
    first = F.shiftright(F.col("at"), 20).cast("int")
    spans = F.coalesce(F.transform("rel", lambda x: x + first), F.array(first, first + F.col("windows") + (length - 1)))
    return found.join(marks, KIND).select(*KEYS, spans.alias("at")).groupBy(*KEYS).agg(F.flatten(F.collect_list("at")).alias("at"))


def dealt_again(parts: DataFrame, length: int, gram: int, hot: int, hot_bytes: int) -> DataFrame:
    """KIND and ``rel`` of kinds (KIND, part), taken as texts, by longer anchors."""
    keys = [F.col("whole").alias("kid"), F.xxhash64("anchor", "windows").alias("kh")]
    found = repeats(parts.select(F.col("part").alias("text"), *keys), length, gram + (length - gram) * 4 // 5, hot, hot_bytes, again=False)
    return parts.select(*KIND, *keys).join(found, KEYS).select(*KIND, F.col("at").alias("rel"))


def of_windows(parts: DataFrame, length: int) -> DataFrame:
    """KIND and ``rel`` of kinds (KIND, part) by their windows, counted over all tasks."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, p in enumerate(tb.column(batch, "part")):
                h = grams(np.frombuffer(p.as_buffer(), np.uint8), length)
                same = [batch.column(k).take(pa.array(np.full(len(h), i))) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *same, pa.array(np.arange(len(h), dtype=np.int32))], ["h", *KIND, "start"])

    each = parts.select(*KIND, "part").mapInArrow(explode, "h long, anchor long, whole long, windows int, start int")
    twice = each.groupBy("anchor", "h").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "h")
    return each.join(twice, ["anchor", "h"]).groupBy(*KIND).agg(F.flatten(F.collect_list(F.array("start", F.col("start") + length))).alias("rel"))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is left."""
    docs = keyed(docs)
    return remove(docs, repeats(docs, length, gram, hot))


def dedup_text(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs, all columns, without the repeated bytes in their texts."""
    return remove_text(docs, repeats(keyed(docs), length, gram, hot))
