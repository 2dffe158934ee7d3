"""op6's score against the textbook recursion over bits, which shares no code with it."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scanloom.llm import ctw


class Textbook:
    """Willems, Shtarkov and Tjalkens' recursion for each of a byte's eight decisions, over
    trees of byte contexts, with counts frozen after training."""

    def __init__(self, depth):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)

    @staticmethod
    def symbols(text):
        """Each byte with the bytes before it: zeros before a text, 255 at its end."""
        data = list(text.encode()) + [255]
        return [(tuple(([0] * 16 + data[:i])[::-1]), b) for i, b in enumerate(data)]

    @staticmethod
    def decisions(byte):
        for j in range(8):
            yield (j, byte >> (8 - j)), (byte >> (7 - j)) & 1

    def learn(self, text):
        for before, byte in self.symbols(text):
            for place, bit in self.decisions(byte):
                for d in range(self.depth + 1):
                    self.counts[place, before[:d]][bit] += 1
                    if d:
                        self.children[place, before[: d - 1]].add(before[:d])

    def kt(self, node):
        zeros, ones = self.counts[node] if node in self.counts else (0, 0)
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(zeros + ones + 1)

    def weigh(self):
        self.logs = {}
        for place, context in sorted(self.counts, key=lambda x: -len(x[1])):
            own = self.kt((place, context))
            if len(context) < self.depth:
                below = sum(self.logs[place, c] for c in self.children[place, context])
                top = max(own, below)
                own = math.log(0.5) + top + math.log(math.exp(own - top) + math.exp(below - top))
            self.logs[place, context] = own

    def one(self, place, before, d=0):
        """Probability that the next decision is 1: how the root's weighted probability grows."""
        node = place, before[:d]
        if node not in self.counts:
            return 0.5
        zeros, ones = self.counts[node]
        own = (ones + 0.5) / (zeros + ones + 1)
        if d == self.depth or (place, before[: d + 1]) not in self.counts:
            return own  # the longest context seen speaks for longer ones, not an even chance
        share = 0.5 * math.exp(self.kt(node) - self.logs[node])
        return share * own + (1 - share) * self.one(place, before, d + 1)

    def score(self, text):
        total = 0.0
        for before, byte in self.symbols(text):
            for place, bit in self.decisions(byte):
                p = self.one(place, before)
                total += math.log10(p if bit else 1 - p)
        return total


@pytest.mark.parametrize(("depth", "pairs"), [(1, 10**6), (3, 10**6), (3, 40), (5, 200)])
def test_score_is_the_textbook_recursion(spark, depth, pairs):
    """Two kilobytes of repetitive, random, multi-byte, empty and null texts, with all runs
    looked up, or nearly all joined."""
    rng = random.Random(17)
    vocabulary = ["the", "then", "other", "é漢", "x1", "of", "\n"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 25))) for _ in range(30)] + ["", None, "abab" * 20, "".join(map(chr, range(32, 126)))]
    book = Textbook(depth)
    for i, t in enumerate(texts):
        if i % 3:
            book.learn(t or "")
    book.weigh()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["score"] for r in ctw.score(docs, F.col("doc_id") % 3 != 0, depth=depth, pairs=pairs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(book.score(t or ""), rel=1e-4, abs=1e-3), (i, t)
