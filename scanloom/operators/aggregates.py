"""Aggregates at several levels at once, and exact and sketched distinct counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a sketch as a power of two; its relative error is about 1.04 / sqrt(2 ** 14).
SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def levels(df: DataFrame, keys: list[str], sets: list[list[str]], **aggregates: Column) -> DataFrame:
    """The aggregates for each set of keys, and ``level``: one bit a key, the first key's the
    highest, set where the key is summed over (its column is null then).

    Rows are summed up in their task for all sets before the one shuffle.  A null key is a
    group of its own, told from a key that is summed over by the level.  An empty
    table gives no rows, not even for the empty set.
    """
    if stray := {c for s in sets for c in s} - set(keys):
        raise ValueError(f"{sorted(stray)} are no keys")
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in keys))
    return grouped.agg(F.grouping_id().alias("level"), *(c.alias(name) for name, c in aggregates.items()))


def pivoted(df: DataFrame, keys: list[str], by: str, values: list, value: Column, empty: object) -> DataFrame:
    """A row for each group of keys with the aggregate ``value`` of each of the values of
    ``by`` as a column of its name; groups without any get ``empty``.  Values are given, so
    that no job has to look for them; rows of others count nowhere but keep their group."""
    return df.groupBy(*keys).pivot(by, values).agg(value).fillna(empty, [str(v) for v in values])


def distinct_counts(df: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """For each group and each of ``values`` the number of its distinct values, nulls left
    out, as one column a value.

    Each value is one row of (group, its column, itself), so that repeats go in the task and
    then by a shuffle on all three: a group with most of the rows is spread by its values.
    What is counted per group after that are partial sums.
    """
    places = F.posexplode(F.array(*(F.col(c).cast("string") for c in values))).alias("_place", "_value")
    rows = df.select(*group, places).groupBy(*group, "_place", "_value").agg(F.lit(1).alias("_one"))
    counts = (F.count(F.when((F.col("_place") == i) & F.col("_value").isNotNull(), 1)).alias(c) for i, c in enumerate(values))
    return rows.groupBy(*group).agg(*counts)


def sketches(df: DataFrame, group: list[str], value: str, bits: int = SKETCH_BITS) -> DataFrame:
    """A sketch of the distinct values of each group, to be kept as a table."""
    return df.groupBy(*group).agg(F.hll_sketch_agg(value, bits).alias("sketch"))


def merged_estimates(table: DataFrame, group: list[str]) -> DataFrame:
    """Estimated distinct values of coarser groups from a table of sketches."""
    return table.groupBy(*group).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
