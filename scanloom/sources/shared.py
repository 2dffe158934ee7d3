"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Where it is unset, a temporary folder will do
    on one machine; a cluster has to name one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="scanloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder: lineage ends here, and joins with it have
    known sizes and can be split where a key is frequent."""
    path = f"{shared_dir(df.sparkSession)}/scanloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
