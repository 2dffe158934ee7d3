"""Input tables and request bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import scalar as S

BODY_BYTES = 5_000_000
LAYOUT_VERSION = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scans(spark: SparkSession, path: str) -> DataFrame:
    """Image files as rows: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").load(path).filter(S.is_scan(F.col("path")))


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """Stored layouts of the current rule version; broken lines are skipped."""
    schema = "file string, ver int, tiers array<double>, ratio double, read_ratio double, std_pitch double"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter(F.col("ver") == LAYOUT_VERSION)


def save_layouts(layouts_: DataFrame, path: str) -> None:
    """Replace the stored layouts by these, under the current rule version."""
    layouts_.withColumn("ver", F.lit(LAYOUT_VERSION)).write.mode("overwrite").json(path)


def body(c: Column) -> Column:
    """A request body as VARIANT: at most BODY_BYTES of JSON, an object; empty is {}."""
    parsed = F.try_parse_json(F.when(c == "", "{}").otherwise(c))
    return F.when((F.octet_length(c) <= BODY_BYTES) & F.schema_of_variant(parsed).startswith("OBJECT"), parsed)
