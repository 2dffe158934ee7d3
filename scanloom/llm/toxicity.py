"""Counterfactual-regularised toxicity classifier.

A logistic model over binary features (words and word beginnings of a text) is fitted
on a bounded sample of labelled rows (``SAMPLE_PER_CLASS`` of each class); the intercept is
then moved by the log-odds of the classes among all labelled rows, so that the share of a
class in the sample does not tell at which score a text is rejected.  Each sample text that
names an identity group is paired with its counterfactuals, the same text with every term
swapped for another of its list, one for each of the others; the loss adds ``penalty`` times
the squared change of score (in log-odds, where sure scores still show it), so that a neutral
mention of a group does not move a score.  Every whole text is scored.

The model's size is bounded by parameters: the ``FEATURES`` whose counts differ most between
the classes, of those that at least ``LEAST_DOCS`` sample texts have and whose chi-square is
``LEAST_CHI2`` or more.

Cases: null and empty texts have no features and get the score of the intercept; no
labelled rows give the score 0; rows with a null label are not learned from, nor is a doc_id
labelled both ways; of rows that share a labelled doc_id the least text is learned from;
repeated rows give repeated rows; a null doc_id is scored like any other; an empty table
gives an empty one; extra columns stay unread.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm import textbuf as tb

#: Labelled rows learned from: at most so many of each class, by the order of a hash.
SAMPLE_PER_CLASS = 4000
#: Features kept for the model: those whose counts differ most between the classes.
FEATURES = 4096
LEAST_DOCS = 4
LEAST_CHI2 = 12.0
PENALTY = 5.0
PREFIXES = (4, 5, 6)
#: Interchangeable identity terms by list; a term is swapped for the next of its list.
IDENTITY = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("women", "men"), ("woman", "man"), ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("christen", "muslime", "juden"), ("chrétiens", "musulmans", "juifs"), ("cristianos", "musulmanes", "judíos"),
)
_TAGS = np.array([0x51ED270B, 0x9D2C5681, 0x2545F491, 0x6C078965], np.uint64)


def word_features(word: str) -> list[int]:
    """The feature of a word, then those of its beginnings."""
    return features(*tb.buffer(pa.array([word])))[1].tolist()


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature hash) of each word and word beginning, marks cut off."""
    low = tb.lower(buf)
    starts, ends = tb.word_spans(low, offs)
    mark = np.ones(256, bool)
    for lo, hi in ((48, 57), (97, 122), (128, 255)):
        mark[lo : hi + 1] = False
    for _ in range(4):
        ends = ends - (mark[low[ends - 1]] & (ends - starts > 1))
        starts = starts + (mark[low[starts]] & (ends - starts > 1))
    text = np.searchsorted(offs, starts, side="right") - 1
    texts, hashes = [text], [tb.mix(tb.span_hashes(low, starts, ends) ^ _TAGS[0])]
    for length, tag in zip(PREFIXES, _TAGS[1:], strict=True):
        at = np.flatnonzero(ends - starts > length)
        texts.append(text[at])
        hashes.append(tb.mix(tb.span_hashes(low, starts[at], starts[at] + length) ^ tag))
    return np.concatenate(texts), np.concatenate(hashes)


class Chosen:
    """Finds the features of a model in an array of hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.seen = np.zeros(1 << 16, bool)
        self.seen[keys >> np.uint64(48)] = True

    def find(self, text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature number) pairs."""
        if not len(self.keys):
            return text[:0], text[:0]
        maybe = np.flatnonzero(self.seen[h >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == h[maybe]
        pair = np.unique(text[maybe[ok]] * len(self.keys) + at[ok])
        return pair // len(self.keys), pair % len(self.keys)


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -40.0


def swapped(text: str, identity=IDENTITY) -> list[str]:
    """The text's counterfactuals: every identity term swapped for another of its list (the
    next, the second next, ...); none if it names no group."""
    of = {w: (words, i) for words in identity for i, w in enumerate(words)}
    pattern = re.compile(r"(?<!\w)(" + "|".join(sorted(of, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
    longest = max((len(of[m.lower()][0]) for m in pattern.findall(text) if m.lower() in of), default=0)

    def other(step: int):
        def swap(m: re.Match) -> str:
            words, i = of.get(m[0].lower(), ((m[0],), 0))
            return words[(i + 1 + (step - 1) % max(1, len(words) - 1)) % len(words)]

        return swap

    return [pattern.sub(other(step), text) for step in range(1, longest)]


def _labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the ids that are labelled one way."""
    y = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    return y.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")


def _sample(docs: DataFrame, y: DataFrame, per_class: int) -> DataFrame:
    """Labelled texts, at most per_class of each class, in the order of a hash."""
    # xxhash64 has a fixed value for an id at any size, so the same rows are preferred
    # whatever the partitioning; the two small top-k reports hold ids alone.
    with_text = docs.select("doc_id", "text").join(y, "doc_id")
    order = F.xxhash64(F.col("doc_id"))
    known = with_text.select("doc_id", "toxic").distinct()
    ids = [known.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    chosen = ids[0].union(ids[1])  # per_class bounds it
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, n_features: int = FEATURES, penalty: float = PENALTY, identity=IDENTITY) -> Model:
    """Fit on at most per_class labelled rows of each class; the driver gets the counts
    of the chosen features and the sample's feature numbers, never texts."""
    from scanloom.llm.lineage import cut, drop

    y_all = _labels(labels)
    sample = cut(_sample(docs, y_all, per_class).repartition(16), "toxicity-sample")
    every = {r["toxic"]: r["n"] for r in y_all.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not total.get(0) or not total.get(1):
        drop(sample)
        share = total.get(1, 0) / max(1, sum(total.values()))
        return Model(bias=40.0 if share else -40.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ones, zeros = [], [], []
        for batch in batches:
            buf, offs = tb.buffer(batch.column(0))
            y = np.array(batch.column(1).to_pylist(), np.int64)
            for lo, hi in tb.groups(offs, 1 << 21):
                text, h = features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                u, inv = np.unique(h[first], return_inverse=True)
                toxic = y[lo:hi][text[first]]
                keys.append(u)
                ones.append(np.bincount(inv, toxic, len(u)))
                zeros.append(np.bincount(inv, 1 - toxic, len(u)))
        if keys:
            u, inv = np.unique(np.concatenate(keys), return_inverse=True)
            n1, n0 = (np.bincount(inv, np.concatenate(x), len(u)).astype(np.int64) for x in (ones, zeros))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n1), pa.array(n0)], ["key", "n1", "n0"])

    n1, n0 = float(total[1]), float(total[0])
    counts = sample.mapInArrow(count, "key long, n1 long, n0 long").groupBy("key").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    a, b = F.col("n1"), F.col("n0")
    chi2 = (a * n0 - b * n1) ** 2 * (n1 + n0) / (n1 * n0 * (a + b) * (n1 + n0 - a - b + 1))
    best = counts.filter(a + b >= LEAST_DOCS).withColumn("chi2", chi2).filter(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "key").limit(n_features)
    picked = np.array([r["key"] for r in best.select("key").collect()], np.int64).view(np.uint64)
    terms = [h for words in identity for w in words for h in word_features(w)]
    keys = np.unique(np.concatenate([picked, np.array(terms, np.uint64)]))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = Chosen(keys)

        def of(column: pa.Array) -> list[list[int]]:
            buf, offs = tb.buffer(column)
            out = []
            for lo, hi in tb.groups(offs, 1 << 21):
                text, at = chosen.find(*features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]))
                ends = np.searchsorted(text, np.arange(hi - lo + 1))
                out += [at[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            return out

        for batch in batches:
            others = [of(pa.array(swapped(t or "", identity), pa.string())) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.int32()), pa.array(of(batch.column(0)), pa.list_(pa.int32())), pa.array(others, pa.list_(pa.list_(pa.int32())))], ["toxic", "at", "others"]
            )

    rows = sample.mapInArrow(numbers, "toxic int, at array<int>, others array<array<int>>").collect()
    drop(sample)
    y = np.array([r["toxic"] for r in rows], float)
    weights, bias = _descend([r["at"] for r in rows], y, len(keys), [(i, o) for i, r in enumerate(rows) for o in r["others"]], penalty)
    return Model(keys, weights, bias + math.log(every[1] / every[0]) - math.log(total[1] / total[0]))


def _descend(rows: list[list[int]], y: np.ndarray, n: int, pairs: list[tuple[int, list[int]]], penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss + penalty * mean squared change of log-odds between a row
    and each of its counterfactuals (row, features) + L2."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64, len(row))
    of = np.array([i for i, _ in pairs], np.int64)
    crow = np.repeat(np.arange(len(pairs)), [len(r) for _, r in pairs])
    ccol = np.fromiter((c for _, r in pairs for c in r), np.int64, len(crow))
    w, bias, m, v = np.zeros(n + 1), 0.0, np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], len(rows)) + w[n]
        s = 1 / (1 + np.exp(-z))
        dz = (s - y) / len(rows)
        grad = np.zeros(n + 1)
        if len(of):
            d = 2 * penalty * (z[of] - np.bincount(crow, w[ccol], len(of)) - w[n]) / len(of)
            dz = dz + np.bincount(of, d, len(rows))
            dc = -d
            grad[:n] += np.bincount(ccol, dc[crow], n)
            grad[n] += dc.sum()
        grad[:n] += np.bincount(col, dz[row], n) + 1e-4 * w[:n]
        grad[n] += dz.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    bias = float(w[n])
    return w[:n], bias


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of the whole
    text; columns of these names in docs are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES bounds it
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    docs = docs.select(kept)
    names = [*kept, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        chosen = Chosen(m.keys)
        for batch in batches:
            buf, offs = tb.buffer(tb.column(batch, "text"))
            z = np.full(batch.num_rows, m.bias)
            for lo, hi in tb.groups(offs, 1 << 21):
                text, at = chosen.find(*features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]))
                z[lo:hi] += np.bincount(text, m.weights[at], hi - lo)
            s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names)

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)
