"""Requests as a stream against the layouts that there are: answers, and new work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scanloom.operators.requests import to_inspect, with_layout


def _parts(df: DataFrame, path: str, before: int) -> DataFrame | None:
    """What earlier batches have written."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    # Batches are a folder each, written whole or not named _SUCCESS.
    if not fs.exists(place) or not any(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")) for x in fs.listStatus(place)):
        return None
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").filter(F.col("batch") < before)


def serve(requests: DataFrame, layouts: Callable[[], DataFrame], answers: str, work: str, checkpoint: str, file: str = "file") -> StreamingQuery:
    """Answer a stream of requests that name a file until what is there now is read.

    Each micro-batch is joined to the layouts as they are then (``layouts`` is called for
    each): ``answers`` gets every request with its layout and code (409 where there is none),
    ``work`` every file without one, each once over all batches.  A batch is a folder of
    either table by its number, replaced when the batch is run again after a failure, and
    work looks at the folders of earlier batches only, so no row is there twice.
    A null file is answered 409 and gives no work.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        try:
            known = layouts()
            with_layout(rows, known, file).write.mode("overwrite").parquet(f"{answers}/batch={number}")
            new = to_inspect(rows, known, file)
            earlier = _parts(rows, work, number)
            if earlier is not None:
                new = new.join(earlier.select("file"), "file", "left_anti")
            new.write.mode("overwrite").parquet(f"{work}/batch={number}")
        finally:
            rows.unpersist()

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
