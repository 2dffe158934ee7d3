"""Joins of intervals that overlap, by bins of several widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.sources.shared import written

#: Each width of bins is so many times the one below it; the narrowest is 1.
GROWTH = 8.0
#: Rows of one bin that one task takes of a side; a fuller bin is split.
BIN_ROWS = 20_000
#: Rows of both sides that one task joins, and those of a group of bins that are counted together.
TASK_ROWS = 500_000
GROUP_ROWS = 1_000
#: Ends beyond this are placed as if they were this.
FAR = 1e300


def _number(c: Column, kind: str) -> Column:
    """Places as doubles, times in microseconds.  Rounding keeps their order, which is all
    that bins need; whether two intervals overlap is decided on the columns themselves."""
    if kind == "timestamp_ntz":
        c = F.unix_micros(c.cast("timestamp"))
    elif kind == "timestamp":
        c = F.unix_micros(c)
    elif kind == "date":
        c = F.unix_date(c)
    return F.greatest(F.least(c.cast("double"), F.lit(FAR)), F.lit(-FAR))


def _measured(df: DataFrame, span: tuple[str, str], on: list[str], side: str, closed: bool) -> DataFrame:
    """Keys, ends, the least level whose bins are as wide as the interval, and the row."""
    kinds, (start, end) = dict(df.dtypes), span
    fine = F.col(start) <= F.col(end) if closed else F.col(start) < F.col(end)
    for c in span:
        fine = fine & ~F.isnan(F.col(c)) if kinds[c] in ("double", "float") else fine
    for c in on:
        fine = fine & F.col(c).isNotNull()
    a, b = (_number(F.col(c), kinds[c]) for c in span)
    rows = df.filter(F.coalesce(fine, F.lit(False))).select(*(F.col(c).alias(f"_key{i}") for i, c in enumerate(on)), a.alias(f"_a_{side}"), b.alias("_b"), F.struct(*df.columns).alias(side))
    level = F.ceil(F.log(GROWTH, F.greatest(F.col("_b") - F.col(f"_a_{side}"), F.lit(1.0)))).cast("int")
    return rows.withColumn(f"_level_{side}", level)


def _bin(place: Column, level: Column) -> Column:
    return F.floor(place / F.pow(F.lit(GROWTH), level))


def _binned(rows: DataFrame, side: str, others: list[int]) -> DataFrame:
    """rows once for each bin: of their own level, and of those wider ones where rows of the
    other side are at home; two bins a level at most."""
    own = F.col(f"_level_{side}")
    wider = F.filter(F.array(*(F.lit(x) for x in others)).cast("array<int>"), lambda x: x > own)
    at = rows.withColumn("_level", F.explode(F.concat(F.array(own), wider)))
    bins = F.sequence(_bin(F.col(f"_a_{side}"), F.col("_level")), _bin(F.col("_b"), F.col("_level")))
    return at.withColumn("_bin", F.explode(bins)).drop("_b")


def _parts(a: DataFrame, b: DataFrame) -> int:
    """Tasks for the rows of both (tables that were written), the session's number at least."""
    return max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), (a.count() + b.count()) // TASK_ROWS + 1)


def interval_join(left: DataFrame, right: DataFrame, on: dict[str, str], left_span: tuple[str, str], right_span: tuple[str, str], closed: bool = True, bin_rows: int = BIN_ROWS) -> DataFrame:
    """All pairs of rows whose keys (``on``: columns of left to those of right; may be empty)
    are equal and whose intervals share a point: both ends belong to them if ``closed``,
    else the start alone.

    Rows with a null or NaN end or a null key, and intervals that end before they start
    (or where they start, if not ``closed``), match nothing.  Columns on both sides are refused.

    An interval lies in two bins at most of the width next above its length, and in two of
    each wider kind that intervals of the other side use.  A pair meets in bins of the wider
    one's width, and counts in the first that both share.  Bins with more than ``bin_rows``
    rows of a side are cut into pieces of that, each of which meets all of the other side's.
    """
    if clash := {*left.columns} & {*right.columns}:
        raise ValueError(f"columns {sorted(clash)} would be there twice")
    keys = [f"_key{i}" for i in range(len(on))]
    place = [*keys, "_level", "_bin"]
    a = _measured(left, left_span, list(on), "l", closed)
    b = _measured(right, right_span, list(on.values()), "r", closed)
    homes = {side: sorted(r[0] for r in rows.select(f"_level_{side}").distinct().collect()) for side, rows in (("l", a), ("r", b))}  # a few hundred widths at most
    a, b = written(_binned(a, "l", homes["r"]), "binned"), written(_binned(b, "r", homes["l"]), "binned")
    parts = _parts(a, b)
    # Bins are nearly as many as rows, so first groups of them are counted; a full one is broadcast
    # by its number, of which there are fewer than rows by bin_rows.
    group = F.pmod(F.xxhash64(*place), F.lit(parts * TASK_ROWS // GROUP_ROWS + 1)).alias("_group")
    placed = a.select(*place, group, F.lit(1).alias("_n"), F.lit(0).alias("_m")).union(b.select(*place, group, F.lit(0), F.lit(1)))
    heavy = placed.groupBy("_group").agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m")).filter((F.col("_n") > bin_rows) | (F.col("_m") > bin_rows)).select("_group")
    full = placed.join(F.broadcast(heavy), "_group", "left_semi").groupBy(*place).agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m"))
    full = full.select(*place, *(F.ceil(F.col(n) / bin_rows).cast("int").alias(pieces) for n, pieces in (("_n", "_pl"), ("_m", "_pr")))).filter("_pl > 0 and _pr > 0 and (_pl > 1 or _pr > 1)")
    full = written(full, "full-bins")
    if not full.isEmpty():

        def dealt(rows: DataFrame, side: str, own: str, other: str) -> DataFrame:
            """rows in a piece of their own side, once for each piece of the other."""
            pieces = F.coalesce(own, F.lit(1))
            rows = rows.join(full, place, "left").withColumn(f"_piece{own}", F.pmod(F.xxhash64(side), pieces).cast("int"))
            return rows.withColumn(f"_piece{other}", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("_pl", "_pr")

        a, b = written(dealt(a, "l", "_pl", "_pr"), "dealt"), written(dealt(b, "r", "_pr", "_pl"), "dealt")
        place = [*place, "_piece_pl", "_piece_pr"]
        parts = _parts(a, b)
    # The number is given, so that a task sorts as many rows however many there are.
    met = a.repartition(parts, *place).join(b.repartition(parts, *place), place)
    widest = F.greatest("_level_l", "_level_r")
    first = F.greatest(_bin(F.col("_a_l"), F.col("_level")), _bin(F.col("_a_r"), F.col("_level")))
    (la, lb), (ra, rb) = ([F.col(f"{side}.{c}") for c in span] for side, span in (("l", left_span), ("r", right_span)))
    shared = (la <= rb) & (ra <= lb) if closed else (la < rb) & (ra < lb)
    return met.filter((F.col("_level") == widest) & (F.col("_bin") == first) & shared).select("l.*", "r.*")
