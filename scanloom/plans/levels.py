"""Queries with aggregates at several levels, sketches, windows over streams and table functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from scanloom.operators import aggregates as A
from scanloom.operators import tables as T
from scanloom.plans.register import query
from scanloom.sources.shared import shared_dir, written
from scanloom.sources.tables import table
from scanloom.streaming import windows
from scanloom.streaming.states import event_stream


@query("""
SELECT l_returnflag AS flag, l_linestatus AS status, year(l_shipdate) AS year, GROUPING(l_returnflag, l_linestatus, year(l_shipdate)) AS level, count(*) AS n, sum(l_quantity)::BIGINT AS quantity, max(l_extendedprice) AS dearest
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, year(l_shipdate)), (l_returnflag, l_linestatus), (l_linestatus, year(l_shipdate)), (year(l_shipdate)), ())""")
def shipment_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.year("l_shipdate").cast("long").alias("year"), "l_quantity", "l_extendedprice")
    sets = [["flag", "status", "year"], ["flag", "status"], ["status", "year"], ["year"], []]
    return A.levels(lines, ["flag", "status", "year"], sets, n=F.count("*"), quantity=F.sum("l_quantity").cast("long"), dearest=F.max("l_extendedprice"))


@query("""
SELECT c_nationkey AS nation, c_mktsegment AS segment, GROUPING(c_nationkey, c_mktsegment) AS level, count(*) AS orders, count(DISTINCT c_custkey) AS buyers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_nationkey, c_mktsegment)""")
def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and buyers by nation and segment, at all four levels."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_custkey")
    # By customer first: what the sets multiply are customers, not orders.
    buyers = rows.groupBy("nation", "segment", "c_custkey").agg(F.count("*").alias("n"))
    return A.levels(buyers, ["nation", "segment"], [["nation", "segment"], ["nation"], ["segment"], []], orders=F.sum("n"), buyers=F.count("*"))


@query("""
SELECT year(o_orderdate) AS year, o_orderstatus AS status, count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-URGENT", count(*) FILTER (o_orderpriority = '2-HIGH') AS "2-HIGH", count(*) FILTER (o_orderpriority = '5-LOW') AS "5-LOW" FROM orders GROUP BY 1, 2""")
def priority_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderstatus").alias("status"), "o_orderpriority")
    return A.pivoted(orders, ["year", "status"], "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"], F.count(F.lit(1)), 0)


@query("""
WITH e AS (SELECT CASE WHEN event_type IN ('view', 'click', 'signup', 'error') THEN 'other' ELSE event_type END AS kind, * FROM events)
SELECT kind, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS events, count(DISTINCT props) AS props, true AS sketch_close FROM e GROUP BY 1""")
def distinct_visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users, events and props of a kind of four fifths of all events and of
    another; and whether daily sketches of the events, kept as a table and merged, agree
    within four standard errors."""
    kind = F.when(F.col("event_type").isin("view", "click", "signup", "error"), "other").otherwise(F.col("event_type"))
    events = table(spark, sf_dir, "events").select(kind.alias("kind"), "user_id", "event_id", "props", F.to_date("ts").alias("day"))
    exact = A.distinct_counts(events, ["kind"], ["user_id", "event_id", "props"])
    daily = written(A.sketches(events, ["kind", "day"], "event_id"), "sketches")
    close = F.abs(F.col("estimate") - F.col("event_id")) <= 4 * A.SKETCH_ERROR * F.col("event_id")
    return exact.join(A.merged_estimates(daily, ["kind"]), "kind").select("kind", F.col("user_id").alias("users"), F.col("event_id").alias("events"), "props", close.alias("sketch_close"))


def _late_files(spark: SparkSession, sf_dir: str, name: str, parts: int = 3) -> str:
    """events as files in the order in which they come, up to two hours after their time."""
    path = f"{shared_dir(spark)}/scanloom-{name}-{uuid.uuid4().hex}"
    delay = F.make_interval(secs=(F.col("event_id") * 7919 % 7200).cast("decimal(18,6)"))
    events = table(spark, sf_dir, "events").withColumn("came", F.col("ts").cast("timestamp") + delay)
    ends = events.agg(F.min(F.unix_micros("came")).alias("low"), F.max(F.unix_micros("came")).alias("high"))  # one row
    step = F.floor((F.unix_micros("came") - F.col("low")) * parts / (F.col("high") - F.col("low") + 1))
    for part in range(parts):
        events.crossJoin(ends).filter(step == part).drop("came", "low", "high").coalesce(1).write.mode("append").parquet(f"{path}/in")
    return path


@query("""
WITH e AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER w > INTERVAL 3 HOUR, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e),
g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 3 HOUR AS "end", count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, no)
SELECT user_id, start, "end", n, total FROM g WHERE epoch_ms("end") <= (SELECT max(epoch_ms(ts)) FROM events) - 7200000""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user from a stream out of order, those that are over by its end."""
    path = _late_files(spark, sf_dir, "sessions")
    found = windows.sessions(event_stream(spark, f"{path}/in", "*.parquet", 1), "user_id", "3 hours", "2 hours")
    windows.append_to(found, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    out = spark.read.schema("user_id long, start timestamp, end timestamp, n long, total double").parquet(f"{path}/out")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 6).alias("total"))


@query("""
WITH w AS (SELECT event_type, unnest(range(0, 6)) AS k, date_trunc('hour', ts) AS h, value FROM events),
g AS (SELECT event_type, h - to_hours(k) AS start, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY 1, 2)
SELECT event_type, start, start + INTERVAL 6 HOUR AS "end", n, total FROM g WHERE epoch_ms(start + INTERVAL 6 HOUR) <= (SELECT max(epoch_ms(ts)) FROM events) - 7200000""")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of six hours every hour, from the same stream."""
    path = _late_files(spark, sf_dir, "sliding")
    found = windows.sliding(event_stream(spark, f"{path}/in", "*.parquet", 1), "event_type", "6 hours", "1 hour", "2 hours")
    windows.append_to(found, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    out = spark.read.schema("event_type string, start timestamp, end timestamp, n long, total double").parquet(f"{path}/out")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 6).alias("total"))


def _turn_lines(row):
    """Each line of a turn that isn't blank, in place of recognised columns."""
    for line in (row["text"] or "").split("\n"):
        if line.strip():
            yield row["turn"], line


@query("""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS line, turn, text FROM l WHERE trim(text) <> ''""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages whose turns give lines, numbered through each page."""
    function = T.lines_of(_turn_lines, [StructField("turn", LongType()), StructField("text", StringType())], "conv_id", ["turn"])
    return T.read_pages(spark, table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "page_lines", function)
