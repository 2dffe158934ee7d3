"""Sessions and sliding windows over a stream whose rows come late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of each key: rows at most ``gap`` apart, with start, end (the last row's time
    plus the gap), n and total.  In append mode a session comes out once the watermark,
    ``late`` behind the greatest time, has passed its end; rows behind it are left out."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sliding(events: DataFrame, key: str, size: str, step: str, late: str) -> DataFrame:
    """Counts and totals of each key in windows of ``size`` that begin every ``step``."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now to a table, each result once, however often it is restarted."""
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def left_out(query: StreamingQuery) -> int:
    """Rows that a query's watermark has left out so far, as its progress reports have them
    (rows that were summed up in a task before count as one)."""
    return sum(op["numRowsDroppedByWatermark"] for report in query.recentProgress for op in report["stateOperators"])
