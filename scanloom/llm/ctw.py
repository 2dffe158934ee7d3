"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, one for each place in the tree of its leading bits;
each decision has its own tree of contexts, the ``DEPTH`` bytes before it.  A node's
Krichevsky-Trofimov estimate and the product of its children's weighted probabilities
are mixed half and half, from the leaves up; a prediction mixes the estimates of all
depths along the context's path by the resulting weights; where the path leaves the tree,
the last node's estimate has the weight that is left.  Training counts every run
of DEPTH + 1 bytes of all training texts in Spark, and all of them form the tree: the
contexts that share their last ``ROOT`` bytes are a subtree, weighed as a whole in one
task; the driver weighs what is above (of a size bounded by ROOT) and sends it back.
So each distinct run of all texts gets its log10, in a table.  The ``PAIRS`` runs seen
most often are broadcast and looked up; a text's other runs are joined to the table.

Word counts for the base score (add-one unigrams) are bounded in the same way for the
words that tasks look up; all rarer words are joined, so each count is exact.

Cases: null is an empty text, which still has its end; nothing to learn from gives
every bit the probability one half; repeated rows give repeated rows; an empty table
gives an empty one; columns other than ``doc_id`` and ``text`` stay unread.  Words and
byte runs are counted by 64-bit keys (byte runs exactly, words by hash).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import textbuf as tb
from scanloom.llm.lineage import cut

DEPTH = 5
PAIRS = 600_000
#: Bytes of context at the roots of the subtrees, and the runs weighed at a time.
ROOT = 2
CHUNK = 1 << 18
WORDS = 1 << 18
#: Ends a text; no byte of UTF-8 has this value.  Before a text stand zero bytes.
END = 255
FLUSH = 1 << 21
#: Bytes of a text taken at a time.
BLOCK = 1 << 21
COUNTED = "kind int, key long, n long"
SCORED = "row long, doc_id long, n_bytes long, n_tokens long, n_known long, base_sum double, score_sum double, rare array<long>, times array<int>, deep array<long>, deep_times array<int>"
ROOTS = "key long, zeros double, ones double, weighted double"
MODEL = "key long, n long, log float"
U = np.uint64


def padded(buf: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ``depth`` zero bytes before and END behind each, and their offsets."""
    at = offs + (depth + 1) * np.arange(len(offs))
    out, own = np.zeros(at[-1], np.uint8), np.ones(at[-1], bool)
    for j in range(depth):
        own[at[:-1] + j] = False
    own[at[1:] - 1] = False
    out[own] = buf
    out[at[1:] - 1] = END
    return out, at


def runs(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Each text's runs of depth + 1 bytes, as integers, oldest byte highest."""
    ends = np.ones(len(data), bool)
    for j in range(depth):
        ends[at[:-1] + j] = False
    key = np.zeros(len(data) - depth, U)
    for j in range(depth + 1):
        key = (key << U(8)) | data[j : len(data) - depth + j].astype(U)
    return key[ends[depth:]]


class Tally:
    """Counts of keys, kept small by merging."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        u, n = np.unique(keys, return_counts=True)
        self.parts.append((u, n))
        self.size += len(u)
        if self.size > 2 * FLUSH:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, U), np.zeros(0, np.int64)
        u, inv = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        return u, np.bincount(inv, np.concatenate([p[1] for p in self.parts]), len(u)).astype(np.int64)


def count_corpus(texts: DataFrame, depth: int = DEPTH, training=None) -> DataFrame:
    """(kind, key, n): kind 0 counts words by hash, kind 1 runs of depth + 1 bytes; kind 2
    runs of the texts that the condition ``training`` leaves out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = [Tally(), Tally(), Tally()]

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            for kind, tally in enumerate(tallies):
                if tally.size > least:
                    u, n = tally.merged()
                    tallies[kind] = Tally()
                    for lo in range(0, len(u), 1 << 18):
                        part = slice(lo, lo + (1 << 18))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u[part]), kind, np.int32)), pa.array(u[part].view(np.int64)), pa.array(n[part])], ["kind", "key", "n"])

        for batch in batches:
            for learnt in (True, False):
                buf, offs = tb.buffer(batch.column(0).filter(pc.equal(batch.column(1), learnt)))
                for lo, hi in tb.groups(offs, 1 << 21):
                    part, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                    if learnt:
                        tallies[0].add(tb.words(part, o)[0])
                    for _, _, piece, at in tb.blocks(*padded(part, o, depth), BLOCK, depth):
                        tallies[1 if learnt else 2].add(runs(piece, at, depth))
                        yield from flush(FLUSH)
        yield from flush(0)

    learn = F.lit(True) if training is None else F.coalesce(training, F.lit(False))
    return texts.select("text", learn.alias("learn")).mapInArrow(run, COUNTED).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def cutoff(counts: DataFrame, most: int, weight=None) -> int:
    """The least count n from which on at most ``most`` rows of counts remain, or rows of
    a total ``weight`` (a histogram of eighth-octaves, some hundred rows, is collected)."""
    step = F.floor(F.log2("n") * 8)
    total = 0
    weight = F.lit(1) if weight is None else weight
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.sum(weight).alias("rows")).collect(), key=lambda r: -r["step"]):
        total += r["rows"]
        if total > most:
            return math.floor(2 ** ((r["step"] + 1) / 8)) + 1
    return 1


class Table:
    """Open-addressing hash table from distinct 64-bit keys to values, in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, U), np.zeros(1 << bits, values.dtype)
        self.used = np.zeros(1 << bits, bool)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            free = left[~self.used[at[left]]]
            self.keys[at[free]] = keys[free]
            won = free[self.keys[at[free]] == keys[free]]
            self.used[at[won]] = True
            self.values[at[won]] = values[won]
            left = left[~np.isin(left, won, assume_unique=True)]
            at[left] = (at[left] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(keys), missing, self.values.dtype)
        at = self._slot(keys)
        left = None
        for _ in range(self.probes):
            same = self.used[at] & (self.keys[at] == keys if left is None else self.keys[at] == keys[left])
            if left is None:
                out[same] = self.values[at[same]]
                left = np.flatnonzero(~same & self.used[at])
                at = at[left]
            else:
                out[left[same]] = self.values[at[same]]
                go = ~same & self.used[at]
                left, at = left[go], at[go]
            if not len(left):
                break
            at = (at + 1) & self.mask
        return out


_small = np.array([math.lgamma(i + 0.5) for i in range(64)])
_whole = np.array([math.lgamma(i + 1.0) for i in range(64)])


def _lgamma(n: np.ndarray, half: bool) -> np.ndarray:
    """ln Gamma(n + 1/2), or of n + 1, for counts n >= 0."""
    x = n + (0.5 if half else 1.0)
    x = np.maximum(x, 1.0)
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    near = (_small if half else _whole)[np.minimum(n, 63).astype(np.int64)]
    return np.where(n < 63, near, far)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _lgamma(n0, True) + _lgamma(n1, True) - _lgamma(n0 + n1, False) - math.log(math.pi)


@dataclass
class Tree:
    """Predictions of a frozen tree: by (depth, context, place among leading bits) the
    probability of a one, by (depth, context, byte) the log10 of the byte's."""

    depth: int
    nodes: tuple[np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]

    def tables(self) -> tuple[Table, Table, Table]:
        contexts = np.unique(self.pairs[0] >> U(8))
        return Table(*self.nodes), Table(*self.pairs), Table(contexts, np.ones(len(contexts), np.float32))


def _tag(depth: int) -> np.uint64:
    return U(depth + 1) << U(56)


@dataclass
class Levels:
    """Nodes (context << 8 | leading bits) by depth from ``first`` on, sorted, with what
    they counted; ``spread`` has each pair's eight nodes and bits."""

    first: int
    keys: list[np.ndarray]
    zeros: list[np.ndarray]
    ones: list[np.ndarray]
    spread: list[tuple[np.ndarray, np.ndarray]]

    def __post_init__(self):
        self.up = [np.zeros(0, np.int64)]
        for i in range(1, len(self.keys)):
            self.up.append(np.searchsorted(self.keys[i - 1], self.keys[i] & U((1 << (8 * (self.first + i))) - 1)))

    def rise(self, weighted: np.ndarray | None = None) -> np.ndarray:
        """Weighted ln probabilities of the first depth; those of the last may be given."""
        top = len(self.keys) - 1
        self.stop = [np.zeros(0)] * (top + 1)
        for i in range(top, -1, -1):
            zeros, ones, m = self.zeros[i], self.ones[i], len(self.keys[i])
            if i == top:
                weighted, self.stop[i] = log_kt(zeros, ones) if weighted is None else weighted, np.ones(m)
                continue
            own, up = log_kt(zeros, ones), self.up[i + 1]
            rest = log_kt(zeros - np.bincount(up, self.zeros[i + 1], m), ones - np.bincount(up, self.ones[i + 1], m))
            below = np.bincount(up, weighted, m) + rest
            weighted = np.logaddexp(own, below) - math.log(2)
            self.stop[i] = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
        return weighted

    def fall(self, gathered: np.ndarray, rest: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """By depth the probability of a one, and what reaches the last depth: estimates
        gathered and weight left.  What reaches the first depth is given."""
        out = []
        for i in range(len(self.keys)):
            if i:
                p = self.up[i]
                gathered, rest = gathered[p] + rest[p] * self.stop[i - 1][p] * kt[p], rest[p] * (1 - self.stop[i - 1][p])
            kt = (self.ones[i] + 0.5) / (self.zeros[i] + self.ones[i] + 1)
            out.append(gathered + rest * kt)
        return out, gathered, rest

    def pair_logs(self, i: int, one: np.ndarray) -> np.ndarray:
        inv, bits = self.spread[i]
        return np.log10(np.where(bits == 1, one[inv], 1 - one[inv])).sum(0).astype(np.float32)


def levels(by_depth: list[tuple[np.ndarray, np.ndarray]], first: int = 0) -> Levels:
    """From pair counts (context << 8 | byte, n) by depth."""
    keys, zeros, ones, spread = [], [], [], []
    for pair, n in by_depth:
        byte = (pair & U(255)).astype(np.int64)
        ids, bits = [], []
        for j in range(8):
            ids.append((pair & ~U(255)) | ((1 << j) | (byte >> (8 - j))).astype(U))
            bits.append((byte >> (7 - j)) & 1)
        u, inv = np.unique(np.concatenate(ids), return_inverse=True)
        bit, times = np.concatenate(bits), np.tile(n, 8)
        keys.append(u)
        ones.append(np.bincount(inv, bit * times, len(u)))
        zeros.append(np.bincount(inv, (1 - bit) * times, len(u)))
        spread.append((inv.reshape(8, -1).astype(np.int32), np.array(bits, np.int8)))
    return Levels(first, keys, zeros, ones, spread)


def weigh(by_depth: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
    """Context-tree weighting of pair counts (context << 8 | byte, n) by depth."""
    tree = levels(by_depth)
    tree.rise()
    one, _, _ = tree.fall(np.zeros(len(tree.keys[0])), np.ones(len(tree.keys[0])))
    cat = np.concatenate
    nodes = cat([k | _tag(d) for d, k in enumerate(tree.keys)]), cat([p.astype(np.float32) for p in one])
    pairs = cat([p | _tag(d) for d, (p, _) in enumerate(by_depth)]), cat([tree.pair_logs(d, p) for d, p in enumerate(one)])
    return Tree(len(by_depth) - 1, nodes, pairs)


def grow(counts: DataFrame, depth: int = DEPTH, pairs: int = PAIRS) -> Tree:
    """A tree in one place from counts of runs (kind 1): the contexts seen most often, with
    all the bytes seen after them; at most ``pairs`` such bytes reach the driver.  score()
    has the tree of all contexts instead."""
    deep = None
    for d in range(depth + 1):
        key = F.col("key").bitwiseAND((1 << (8 * (d + 1))) - 1)
        level = counts.filter("kind = 1").groupBy(key.alias("key")).agg(F.sum("n").alias("n")).withColumn("d", F.lit(d))
        deep = level if deep is None else deep.union(level)
    # A context has 256 different bytes after it at most.
    contexts = deep.groupBy("d", F.shiftrightunsigned("key", 8).alias("context")).agg(F.sum("n").alias("n"), F.collect_list(F.struct("key", F.col("n").alias("times"))).alias("after"))
    contexts = cut(contexts, "ctw-contexts")
    least = cutoff(contexts, pairs, F.size("after"))
    got = contexts.filter(F.col("n") >= least).select("d", F.explode("after").alias("x")).select("d", "x.key", "x.times").toArrow()
    d, key, n = (got.column(c).to_numpy() for c in ("d", "key", "times"))
    # Shorter contexts have been seen at least as often, so they are all kept as well.
    return weigh([(key[d == i].view(np.uint64), n[d == i].astype(float)) for i in range(depth + 1)])


def byte_log10(tree: Tree, tables: tuple[Table, Table, Table], run: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each run given the bytes before it."""
    nodes, pairs, contexts = tables
    out = np.zeros(len(run), np.float32)
    left = np.arange(len(run))
    for d in range(tree.depth, -1, -1):
        key = (run[left] & U((1 << (8 * (d + 1))) - 1)) | _tag(d)
        got = pairs.get(key, 1.0)
        hit = got <= 0
        out[left[hit]] = got[hit]
        left, key = left[~hit], key[~hit]
        if not len(left):
            return out
        known = contexts.get(key >> U(8), 0.0) > 0
        out[left[known]] = _bits(tree, nodes, run[left[known]], d)
        left = left[~known]
    out[left] = 8 * math.log10(0.5)
    return out


def _bits(tree: Tree, nodes: Table, run: np.ndarray, deepest: int) -> np.ndarray:
    """As byte_log10, bit by bit: for bytes not seen in their longest kept context."""
    total = np.zeros(len(run), np.float32)
    byte = (run & U(255)).astype(np.int64)
    for j in range(8):
        place = ((1 << j) | (byte >> (8 - j))).astype(U)
        one = np.full(len(run), -1, np.float32)
        left = np.arange(len(run))
        for d in range(deepest, -1, -1):
            key = (((run[left] & U((1 << (8 * (d + 1))) - 1)) & ~U(255)) | place[left]) | _tag(d)
            got = nodes.get(key, -1.0)
            one[left] = got
            left = left[got < 0]
            if not len(left):
                break
        one[one < 0] = 0.5
        total += np.log10(np.where((byte >> (7 - j)) & 1 == 1, one, 1 - one))
    return total


def subtree(runs_: np.ndarray, n: np.ndarray, depth: int, root: int) -> Levels:
    """All depths from root on of what distinct runs, sorted, were counted."""
    by_depth = []
    for d in range(root, depth):
        u, inv = np.unique(runs_ & U((1 << (8 * (d + 1))) - 1), return_inverse=True)
        by_depth.append((u, np.bincount(inv, n, len(u))))
    return levels([*by_depth, (runs_, n.astype(float))], root)


def whole(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Sorted by their column root, rows in pieces of about ``rows`` or of one root."""
    held, size, wait = [], 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= wait:
            table = pa.Table.from_batches(held)
            root = tb.column(table, "root").to_numpy()
            at = int(np.searchsorted(root, root[-1]))
            if at:
                yield table.slice(0, at)
            held, size = table.slice(at).to_batches(), size - at
            wait = max(rows, 2 * size)
    if size:
        yield pa.Table.from_batches(held)


def model(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, n, log): log10 of the last byte of each run counted (kinds 1 and 2) by the
    tree of all runs of kind 1, and how often the run was counted in all."""
    spark = counts.sparkSession
    root = min(ROOT, depth)
    rooted = counts.withColumn("root", F.shiftrightunsigned("key", 8).bitwiseAND((1 << (8 * root)) - 1))
    dealt = lambda rows: rows.repartition("root").sortWithinPartitions("root").select("root", "kind", "key", "n")

    def learnt(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        kind, key, n = (tb.column(table, c).to_numpy() for c in ("kind", "key", "n"))
        own, times = key[kind == 1].view(U), n[kind == 1]
        order = np.argsort(own)
        return own[order], times[order], key.view(U), n

    def rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches, CHUNK):
            own, times, _, _ = learnt(table)
            tree = subtree(own, times, depth, root)
            weighted = tree.rise()
            yield pa.RecordBatch.from_arrays([pa.array(tree.keys[0].view(np.int64)), pa.array(tree.zeros[0]), pa.array(tree.ones[0]), pa.array(weighted)], ["key", "zeros", "ones", "weighted"])

    got = dealt(rooted.filter("kind = 1")).mapInArrow(rise, ROOTS).toArrow()
    key, zeros, ones, weighted = (got.column(c).to_numpy() for c in ("key", "zeros", "ones", "weighted"))
    order = np.argsort(key)
    by = [(key[order].view(U), zeros[order], ones[order])]
    for d in range(root, 0, -1):
        u, inv = np.unique(by[0][0] & U((1 << (8 * d)) - 1), return_inverse=True)
        by.insert(0, (u, np.bincount(inv, by[0][1], len(u)), np.bincount(inv, by[0][2], len(u))))
    top = Levels(0, *(list(x) for x in zip(*by, strict=True)), [])
    top.rise(weighted[order])
    one, gathered, rest = top.fall(np.zeros(len(top.keys[0])), np.ones(len(top.keys[0])))
    sent = spark.sparkContext.broadcast((top.keys, one[:-1], gathered, rest))

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, p_above, gathered, rest = sent.value
        for table in whole(batches, CHUNK):
            own, times, key, n = learnt(table)
            tree = subtree(own, times, depth, root)
            tree.rise()
            at = np.searchsorted(above[-1], tree.keys[0])
            one, _, _ = tree.fall(gathered[at], rest[at])
            u, inv = np.unique(key, return_inverse=True)
            log = np.zeros(len(u), np.float32)
            seen = np.isin(u, own, assume_unique=True)
            log[seen] = tree.pair_logs(depth - root, one[-1])
            log[~seen] = new_log10(u[~seen], [*above[:-1], *tree.keys], [*p_above, *one])
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(inv, n, len(u)).astype(np.int64)), pa.array(log)], ["key", "n", "log"])

    return dealt(rooted.filter("kind > 0")).mapInArrow(fall, MODEL)


def new_log10(run: np.ndarray, keys: list[np.ndarray], p: list[np.ndarray]) -> np.ndarray:
    """As byte_log10, bit by bit in the deepest node seen, by nodes sorted by depth."""
    total = np.zeros(len(run))
    byte = (run & U(255)).astype(np.int64)
    for j in range(8):
        place = ((1 << j) | (byte >> (8 - j))).astype(U)
        one = np.full(len(run), 0.5)
        left = np.arange(len(run))
        for d in range(len(keys) - 1, -1, -1):
            if not len(left) or not len(keys[d]):
                continue
            key = (run[left] & U((1 << (8 * (d + 1))) - 1) & ~U(255)) | place[left]
            at = np.minimum(np.searchsorted(keys[d], key), len(keys[d]) - 1)
            hit = keys[d][at] == key
            one[left[hit]] = p[d][at[hit]]
            left = left[~hit]
        total += np.log10(np.where((byte >> (7 - j)) & 1 == 1, one, 1 - one))
    return total.astype(np.float32)


def tallied(keys: np.ndarray, text: np.ndarray, m: int) -> tuple[pa.Array, pa.Array]:
    """By text 0..m-1, its distinct keys and how often it has each, as lists."""
    order = np.lexsort((keys, text))
    k, t = keys[order], text[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    begin = np.flatnonzero(first)
    times = np.diff(np.append(begin, len(k))).astype(np.int32)
    cuts = pa.array(np.searchsorted(t[begin], np.arange(m + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(cuts, pa.array(k[begin].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times))


def score(docs: DataFrame, training, depth: int = DEPTH, pairs: int = PAIRS, words: int = WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score and
    bits_per_byte.  ``training`` is the condition that selects the rows learned from."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = cut(count_corpus(docs, depth, training), "ctw-counts")
    ends = docs.filter(training).count()
    vocabulary = counts.filter("kind = 0")
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, n_distinct = total["n"] + ends, total["v"] + (ends > 0)
    least = cutoff(vocabulary, words)
    often = vocabulary.filter(F.col("n") >= least).select("key", "n").toArrow()
    all_runs = cut(model(counts, depth), "ctw-model")
    least_run = cutoff(all_runs, pairs)
    near = all_runs.filter(F.col("n") >= least_run).select("key", "log").toArrow()
    sent = spark.sparkContext.broadcast(tuple(x.to_numpy() for x in (near.column("key"), near.column("log"), often.column("key"), often.column("n"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_keys, run_logs, keys, n = sent.value
        logs_of, known = Table(run_keys.view(U), run_logs), Table(keys.view(U), n.astype(np.float64))
        row = TaskContext.get().partitionId() << 34
        for batch in batches:
            buf, offs = tb.buffer(batch.column(1))
            for lo, hi in tb.groups(offs, 1 << 20):
                part, o, m = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], hi - lo
                h, at = tb.words(part, o)
                text = np.repeat(np.arange(m), np.diff(at))
                c = known.get(h, 0.0)
                rare = tallied(h[c == 0], text[c == 0], m)
                score_sum, far_runs, far_texts = np.zeros(m), [], []
                for first, _, piece, ends_at in tb.blocks(*padded(part, o, depth), BLOCK, depth):
                    byte_runs = runs(piece, ends_at, depth)
                    logs = logs_of.get(byte_runs, 1.0)
                    far, sizes = logs > 0, np.diff(ends_at) - depth
                    score_sum[first : first + len(sizes)] += np.add.reduceat(np.where(far, 0, logs).astype(np.float64), np.cumsum(sizes) - sizes)
                    far_runs.append(byte_runs[far])
                    far_texts.append(np.repeat(np.arange(first, first + len(sizes)), sizes)[far])
                deep = tallied(np.concatenate(far_runs), np.concatenate(far_texts), m)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(m)), batch.column(0).slice(lo, m), pa.array(np.diff(o)), pa.array(np.diff(at) + 1),
                        pa.array(np.bincount(text, c > 0, m).astype(np.int64) + int(ends > 0)),
                        pa.array(np.bincount(text, np.log10(c + 1), m) + math.log10(ends + 1)),
                        pa.array(score_sum),
                        *rare, *deep,
                    ],
                    ["row", "doc_id", "n_bytes", "n_tokens", "n_known", "base_sum", "score_sum", "rare", "times", "deep", "deep_times"],
                )
                row += m

    scored = cut(docs.mapInArrow(run, SCORED), "ctw-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    joined = rare.join(vocabulary.filter(F.col("n") < least).select("key", "n"), "key")
    extra = joined.groupBy("row").agg(F.sum("times").alias("found"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    deep = scored.select("row", F.explode(F.arrays_zip("deep", "deep_times")).alias("x")).select("row", F.col("x.deep").alias("key"), F.col("x.deep_times").alias("times"))
    # Hashed at every size: a broadcast of the table would grow with the corpus.
    found = deep.join(all_runs.filter(F.col("n") < least_run).select("key", "log").hint("shuffle_hash"), "key")
    below = found.groupBy("row").agg(F.sum(F.col("times") * F.col("log").cast("double")).alias("deep_sum"))
    return scored.join(extra, "row", "left").join(below, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base_sum") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * math.log10(n_all + n_distinct + 1)).alias("base_score"),
        (F.col("score_sum") + F.coalesce("deep_sum", F.lit(0.0))).alias("score"),
        # The end of a text counts as a byte.
        (-(F.col("score_sum") + F.coalesce("deep_sum", F.lit(0.0))) / (math.log10(2) * (F.col("n_bytes") + 1))).alias("bits_per_byte"),
    )
