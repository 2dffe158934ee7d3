"""Joins by time: each row with what was in force at its time."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.sources.shared import written

#: Rows of a range of (key, time) at least.
RANGE_ROWS = 100_000
OWN = ("_at", "_right", "_tie", "_value", "_row", "_part", "_last", "_carry")


def asof_join(
    left: DataFrame, right: DataFrame, on: dict[str, str], left_time: str, right_time: str, take: list[str], tie: str | None = None,
    within: Column | None = None, exact: bool = True, inner: bool = False, rows: int = RANGE_ROWS,
) -> DataFrame:
    """left with the columns ``take`` of the last row of right at or before its time.

    ``on`` maps columns of left to those of right that have to be equal.  Of rows of right
    at one time the one of the largest ``tie`` counts (null least), or any if it is not
    given.  ``exact``: equal times count too.  ``within``: the longest that a row stays in
    force (an interval), which its time plus that still belongs to.  Rows of left without
    such a row, with a null time or a null key get nulls, or go if ``inner``; rows of right
    with a null key or time match nothing.  Columns that would be there twice are refused.

    Both sides are laid out once in ranges of (key, time), so that a key with most of the
    rows fills many ranges; a window finds the last row of right within a range, and what
    earlier ranges leave for a range's first key comes as one row a range, broadcast.
    """
    if clash := set(take) & set(left.columns) or set(OWN) & {*left.columns, *right.columns}:
        raise ValueError(f"columns {sorted(clash)} would be there twice")
    keys = [f"_key{i}" for i in range(len(on))]
    value = F.struct(F.col(right_time).alias("_since"), *(F.col(c) for c in take))
    shape = right.select(value.alias("v")).schema["v"].dataType
    known = reduce(and_, (F.col(c).isNotNull() for c in (*on.values(), right_time)))
    rank = F.col(tie) if tie else F.lit(0)
    side = F.lit(0 if exact else 1)  # with equal times right comes first, or left
    right_rows = right.filter(known).select(
        *(F.col(b).alias(k) for k, b in zip(keys, on.values(), strict=True)), F.col(right_time).alias("_at"), side.alias("_right"), rank.alias("_tie"), value.alias("_value"), F.lit(None).cast(left.schema).alias("_row"),
    )
    left_rows = left.select(
        *(F.col(a).alias(k) for k, a in zip(keys, on, strict=True)), F.col(left_time).alias("_at"), (1 - side).alias("_right"), F.lit(None).cast(right_rows.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(shape).alias("_value"), F.struct(*left.columns).alias("_row"),
    )
    both = right_rows.unionByName(left_rows)
    order = ["_at", "_right", "_tie"]
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), (left.count() + right.count()) // rows + 1)
    placed = written(both.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "asof")

    within_range = Window.partitionBy(*keys, "_part").orderBy(*order)
    last = F.last("_value", ignorenulls=True).over(within_range.rowsBetween(Window.unboundedPreceding, 0))
    ends = placed.groupBy(*keys, "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct("_at", "_tie"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only a range's first key can go on from an earlier range: one row a range at most.
    carry = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).filter("_carry is not null").select(*(F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)), F.col("_part").alias("_in"), "_carry")
    same = reduce(and_, (F.col(k) == F.col(f"_of{i}") for i, k in enumerate(keys)), F.col("_part") == F.col("_in"))
    # The nulls that left rows carry as their value have no end either.
    found = placed.withColumn("_last", last).filter("_row is not null").join(F.broadcast(carry), same, "left")
    found = found.select(*(F.col("_row")[c].alias(c) for c in left.columns), F.coalesce("_last", "_carry").alias("_last"), "_at")
    fine = F.col("_last").isNotNull() & F.col("_at").isNotNull()
    if within is not None:
        fine = fine & (F.col("_at") <= F.col("_last._since") + within)
    if inner:
        found = found.filter(fine)
    return found.select(*left.columns, *(F.when(fine, F.col("_last")[c]).alias(c) for c in take))
