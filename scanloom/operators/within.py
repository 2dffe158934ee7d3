"""Totals of the points within spans of time, without listing a span's points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from scanloom.operators.asof import asof_join
from scanloom.sources.shared import written

#: Rows of a block at least, and blocks at most: the counts of pairs of blocks are kept whole.
BLOCK_ROWS = 50_000
BLOCKS = 512
NEVER, NONE = -(1 << 63), (1 << 63) - 1
POINT, FIRST, CHAIN, START, END = range(5)


def _place(df: DataFrame, name: str) -> Column:
    """Times as microseconds, numbers as they are; zone-free times don't pass through a zone."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, TimestampNTZType):
        seconds = (c - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second").cast("decimal(20,6)")
        return (seconds * 1_000_000).cast("long")
    return F.unix_micros(c) if isinstance(kind, TimestampType) else c.cast("long")


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo:hi] for each pair of ends; NONE of nothing."""
    out = np.full(len(lo), NONE)
    level = np.log2(np.maximum(hi - lo, 1)).astype(int)
    for k in range(int(level.max(initial=0)) + 1):
        if k:  # the least of 2^k values from each place on
            half = 1 << (k - 1)
            values = np.minimum(values[:-half], values[half:])
        at = np.flatnonzero((level == k) & (hi > lo))
        out[at] = np.minimum(values[lo[at]], values[hi[at] - (1 << k)])
    return out


def _below(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """How many of values[lo:hi] are below its limit, for each pair of ends: values are
    split by one bit of their ranks after another, and ends follow their limit's bits."""
    ranks = np.unique(values)
    v, limit = np.searchsorted(ranks, values), np.searchsorted(ranks, limits)
    out = np.zeros(len(lo), dtype=np.int64)
    for bit in reversed(range(len(ranks).bit_length())):
        one = (v >> bit & 1).astype(bool)
        zeros = np.r_[0, np.cumsum(~one)]
        l0, h0, up = zeros[lo], zeros[hi], (limit >> bit & 1).astype(bool)
        out += np.where(up, h0 - l0, 0)
        lo, hi = np.where(up, zeros[-1] + lo - l0, l0), np.where(up, zeros[-1] + hi - h0, h0)
        v = np.r_[v[~one], v[one]]
    return out


def totals_within(spans: DataFrame, points: DataFrame, span: tuple[str, str], at: str, least: str, distinct: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """spans with ``n``, the points whose time ``at`` lies in them (both ends included),
    ``least``, the least of that whole number, and ``distinct``, how many values that column
    has among them.  Spans without a point, with a null end or reversed ones are left out;
    null times are in no span, and other nulls count as in SQL.

    A value counts in a span at its first point there: the one whose last time before is
    earlier than the span.  Times are cut into blocks; a span meets the points of its first
    and last block, and for those between there are totals.  So each point and span is dealt
    to two or three blocks, however many pairs of them there are.  What happens at one
    microsecond is in one block.
    """
    start, end = span
    p = points.select(_place(points, at).alias("_x"), F.col(least).cast("long").alias("_least"), F.col(distinct).alias("_who")).filter("_x is not null")
    q = spans.select(_place(spans, start).alias("_from"), _place(spans, end).alias("_to")).filter("_from <= _to").distinct()
    q = written(q, "spans")
    firsts = written(p.filter("_who is not null").select("_who", "_x").distinct(), "firsts")
    others = firsts.select(F.col("_who").alias("_of"), F.col("_x").alias("_time"), F.col("_x").alias("_prev"))
    firsts = asof_join(firsts, others, {"_who": "_of"}, "_x", "_time", ["_prev"], exact=False)
    firsts = written(firsts.select("_x", F.coalesce("_prev", F.lit(NEVER)).alias("_prev")), "previous")
    p = written(p.groupBy("_x").agg(F.count("*").cast("long").alias("_n"), F.min("_least").alias("_least")), "points")

    parts = min(BLOCKS, max(p.count(), firsts.count(), q.count()) // block_rows + 1)
    every = p.select("_x").union(firsts.select("_x")).union(q.select("_from")).union(q.select("_to"))
    cuts = np.zeros(0, dtype=np.int64)
    if parts > 1:
        cuts = np.unique(np.array(every.agg(F.percentile_approx("_x", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or [], dtype=np.int64))
    m = len(cuts) + 1
    block = F.pandas_udf(lambda x: pd.Series(np.searchsorted(cuts, x.to_numpy(), "right")), "long")

    p = p.withColumn("_block", block("_x"))
    firsts = firsts.withColumns({"_block": block("_x"), "_before": F.when(F.col("_prev") > NEVER, block("_prev")).otherwise(-1)})
    q = q.withColumns({"_block": block("_from"), "_last": block("_to")})
    # A row a block, and a row a pair of blocks.
    counts, leasts, pairs = np.zeros(m + 1, dtype=np.int64), np.full(m, NONE), np.zeros((m + 1, m + 2), dtype=np.int64)
    for b, n, low in p.groupBy("_block").agg(F.sum("_n"), F.min("_least")).collect():
        counts[b + 1], leasts[b] = n, NONE if low is None else low
    for b, before, n in firsts.groupBy("_block", "_before").count().collect():
        pairs[b + 1, before + 2] = n
    counts, pairs = counts.cumsum(), pairs.cumsum(0).cumsum(1)

    def totals(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = key[0]
        by_kind = [rows[rows["kind"] == k] for k in range(5)]
        pts, fst = by_kind[POINT].sort_values("a"), by_kind[FIRST].sort_values("a")
        chain, asked = by_kind[CHAIN].sort_values("a"), pd.concat(by_kind[START:])
        since, until, other = (asked[c].to_numpy() for c in "abc")
        begins = (asked["kind"] == START).to_numpy()
        on = begins & (other > own)  # goes on in later blocks

        def ends(times: pd.Series) -> tuple[np.ndarray, np.ndarray]:
            t = times.to_numpy()
            return np.where(begins, np.searchsorted(t, since), 0), np.where(on, len(t), np.searchsorted(t, until, "right"))

        lo, hi = ends(pts["a"])
        n = np.r_[0, pts["c"].to_numpy().cumsum()]
        n, low = n[hi] - n[lo], _least(pts["b"].to_numpy(), lo, hi)
        new = _below(fst["b"].to_numpy(), *ends(fst["a"]), since)
        # Blocks between: points whose value was last there before this block, or early in it.
        i, to = np.flatnonzero(on), other[on]
        n[i] += counts[to] - counts[own + 1]
        low[i] = np.minimum(low[i], _least(leasts, np.full(len(i), own + 1), to))
        new[i] += pairs[to, own + 1] - pairs[own + 1, own + 1]
        early = np.searchsorted(chain["a"].to_numpy(), since[i])
        new[i] += _below(chain["c"].to_numpy(), np.zeros_like(early), early, to)
        return pd.DataFrame({"_from": since, "_to": until, "n": n, "low": low, "distinct": new})

    row = lambda df, kind, a, b, c, where="_block": df.select(F.col(where).alias("block"), F.lit(kind).alias("kind"), F.col(a).alias("a"), b.alias("b"), c.alias("c"))
    none = F.lit(0).cast("long")
    dealt = row(p, POINT, "_x", F.coalesce("_least", F.lit(NONE)), F.col("_n")).union(row(firsts, FIRST, "_x", F.col("_prev"), none))
    dealt = dealt.union(row(firsts.filter("_before >= 0 and _before < _block"), CHAIN, "_prev", none, F.col("_block"), "_before"))
    dealt = dealt.union(row(q, START, "_from", F.col("_to"), F.col("_last"))).union(row(q.filter("_last > _block"), END, "_from", F.col("_to"), F.col("_block"), "_last"))
    found = dealt.repartition(m, "block").groupBy("block").applyInPandas(totals, "_from long, _to long, n long, low long, distinct long")
    found = found.groupBy("_from", "_to").agg(F.sum("n").alias("n"), F.nullif(F.min("low"), F.lit(NONE)).alias("least"), F.sum("distinct").alias("distinct")).filter("n > 0")
    return spans.withColumns({"_from": _place(spans, start), "_to": _place(spans, end)}).join(found, ["_from", "_to"]).drop("_from", "_to")
