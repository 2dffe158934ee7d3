"""Streaming forms: event counts over windows, and each file's inspection state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators.requests import inspection_step


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files: int = 1000) -> DataFrame:
    """events as a stream, so many files a batch; their zone-free times become UTC instants for watermarks."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def inspections(log: DataFrame) -> DataFrame:
    """State of each file from a stream of (file, event), and what its requests were told: a
    failure is told once, which clears it, so that the request after that starts again."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "absent"
        told = []
        for batch in batches:
            for event in batch.event:
                now, answer = inspection_step(now, event)
                if answer:
                    told.append(answer[0])
        state.update((now,))
        yield pd.DataFrame({"file": [key[0]], "state": [now], "told": [",".join(told)]})

    return log.groupBy("file").applyInPandasWithState(step, "file string, state string, told string", "state string", "update", "NoTimeout")
