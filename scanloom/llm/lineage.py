"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from scanloom.sources.shared import shared_dir


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    A lost executor then costs the unfinished tasks alone, and what follows reads
    columnar files instead of running the steps before it again.
    """
    path = f"{shared_dir(df.sparkSession)}/scanloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scanloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table written by cut() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scanloom_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
