"""User functions from a page to its lines, as table functions over ordered partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, Row, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def lines_of(read: Callable[[Row], Iterator[tuple]], fields: list[StructField], key: str, order: list[str]):
    """A table function over any table with ``key`` and ``order``: rows of one key come
    together and in order, ``read`` turns each into lines (tuples of ``fields``), and each
    line comes with its key and its number from 0 within the key.

    It carries a key's last number and nothing else.  A row for which ``read`` gives nothing
    takes no number; a null key is a key.  Register it and call it with TABLE(...), where
    it joins like any table.
    """

    class Lines:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            kinds = {f.name: f.dataType for f in rows.dataType.fields}
            if missing := [c for c in (key, *order) if c not in kinds]:
                raise ValueError(f"the table has no column {missing}")
            schema = StructType([StructField(key, kinds[key]), StructField("line", LongType()), *fields])
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn(c) for c in order])

        def __init__(self) -> None:
            self.next = 0

        def eval(self, row: Row) -> Iterator[tuple]:
            for found in read(row):
                yield (row[key], self.next, *found)
                self.next += 1

    return udtf(Lines)


def read_pages(spark: SparkSession, pages: DataFrame, name: str, function) -> DataFrame:
    """The lines of pages by a function of lines_of(), registered by name."""
    spark.udtf.register(name, function)
    view = f"_{name}_rows"
    pages.createOrReplaceTempView(view)
    return spark.sql(f"SELECT * FROM {name}(TABLE({view}))")
