"""Queries with joins by time and by overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators.asof import asof_join
from scanloom.operators.intervals import interval_join
from scanloom.operators.within import totals_within
from scanloom.plans.register import query
from scanloom.sources.shared import written
from scanloom.sources.tables import table


@query("""
WITH e AS (SELECT event_id, CASE WHEN user_id % 3 > 0 THEN 0 ELSE user_id END AS file, date_trunc('hour', ts) AS hour, value, event_type = 'signup' AS sets FROM events),
l AS (SELECT file, hour, max_by(value, event_id) AS ratio FROM e WHERE sets GROUP BY 1, 2),
q AS (SELECT * FROM e WHERE NOT sets)
SELECT q.event_id, q.file, CASE WHEN q.hour <= l.hour + INTERVAL 6 HOUR THEN l.ratio END AS ratio FROM q ASOF LEFT JOIN l ON q.file = l.file AND q.hour >= l.hour""")
def layout_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request with the layout in force at its hour, for six hours at most; two thirds
    of all events are of one file, and of layouts of one hour the last counts."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 > 0, 0).otherwise(F.col("user_id")).alias("file"), F.date_trunc("hour", "ts").alias("at"), F.col("value").alias("ratio"), "event_type")
    layouts = e.filter("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("file").alias("of"), F.col("at").alias("set_at"), "ratio")
    asked = e.filter("event_type <> 'signup'").select("event_id", "file", "at")
    found = asof_join(asked, layouts, {"file": "of"}, "at", "set_at", ["ratio"], tie="id", within=F.expr("INTERVAL 6 HOURS"))
    return found.select("event_id", "file", "ratio")


@query("""
WITH o AS (SELECT o_custkey, o_orderdate, max_by(o_totalprice, o_orderkey) AS price, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2),
l AS (SELECT l_orderkey, l_linenumber, l_partkey % 1500 AS cust, l_shipdate FROM lineitem)
SELECT l.l_orderkey, l.l_linenumber, l.l_shipdate, o.o_orderkey, o.price FROM l ASOF JOIN o ON l.cust = o.o_custkey AND l.l_shipdate > o.o_orderdate""")
def price_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shipment with the last order that its customer (here by part) had placed before."""
    shipped = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1500).alias("cust"), "l_shipdate")
    placed = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("price"))
    found = asof_join(shipped, placed, {"cust": "o_custkey"}, "l_shipdate", "o_orderdate", ["o_orderkey", "price"], tie="o_orderkey", exact=False, inner=True)
    return found.drop("cust")


@query("""
WITH b AS (SELECT l_orderkey AS req, l_linenumber, l_partkey % 500 AS x0, l_suppkey % 300 AS y0, l_partkey % 500 + l_quantity::BIGINT * 40 - 40 AS x1, l_suppkey % 300 + l_linenumber * 180 AS y1 FROM lineitem)
SELECT a.req, count(*) AS pairs, sum(a.l_linenumber * b.l_linenumber)::BIGINT AS lines FROM b a JOIN b ON a.req = b.req AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 WHERE a.x0 < a.x1 AND b.x0 < b.x1 GROUP BY 1""")
def boxes_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a request's boxes that share an area, each box with itself among them."""
    x0, y0 = F.col("l_partkey") % 500, F.col("l_suppkey") % 300
    boxes = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("req"), F.col("l_linenumber").alias("line"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity").cast("long") * 40 - 40).alias("x1"), (y0 + F.col("l_linenumber") * 180).alias("y1")
    )
    others = boxes.select(*(F.col(c).alias(f"b_{c}") for c in boxes.columns))
    met = interval_join(boxes, others, {"req": "b_req"}, ("x0", "x1"), ("b_x0", "b_x1"), closed=False).filter("y0 < b_y1 and b_y0 < y1")
    return met.groupBy("req").agg(F.count("*").alias("pairs"), F.sum(F.col("line") * F.col("b_line")).cast("long").alias("lines"))


@query("""
WITH w AS (SELECT event_id AS outage, ts AS since, ts + to_microseconds((value * 60000000)::BIGINT) AS until FROM events WHERE event_type = 'error')
SELECT outage, count(*) AS events, min(event_id) AS first_event, count(DISTINCT user_id) AS users FROM w JOIN events ON ts BETWEEN since AND until GROUP BY 1""")
def events_in_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within the span of each outage, which lasts as many minutes as its value is;
    there is no key besides, and spans are of all lengths."""
    events = table(spark, sf_dir, "events")
    end = F.col("ts") + F.make_dt_interval(secs=(F.round(F.col("value") * 60_000_000) / 1e6).cast("decimal(18,6)"))
    outages = events.filter("event_type = 'error'").select(F.col("event_id").alias("outage"), F.col("ts").alias("since"), end.alias("until"))
    # An id that several outages share (none, as ids go) is one group, in which a user counts once.
    by_id = outages.groupBy("outage").agg(F.count("*").alias("spans"), F.min("since").alias("since"), F.min("until").alias("until"))
    points = events.select("event_id", "user_id", F.col("ts").alias("at"))
    single = totals_within(by_id.filter("spans = 1"), points, ("since", "until"), "at", "event_id", "user_id")
    found = single.select("outage", F.col("n").alias("events"), F.col("least").alias("first_event"), F.col("distinct").alias("users"))
    shared = written(by_id.filter("spans > 1").select(F.col("outage").alias("id")), "shared-ids")
    if shared.isEmpty():
        return found
    met = interval_join(points.withColumn("to", F.col("at")), outages.join(shared, F.col("outage").eqNullSafe(F.col("id")), "left_semi"), {}, ("at", "to"), ("since", "until"))
    return found.union(met.groupBy("outage").agg(F.count("*"), F.min("event_id"), F.count_distinct("user_id")))
