"""Queries over inspections: their measures, their store and their streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators import inspect as I  # noqa: E741
from scanloom.plans.register import query
from scanloom.sources import store
from scanloom.sources.shared import shared_dir
from scanloom.sources.tables import LAYOUT_VERSION, table
from scanloom.streaming import pending, timed
from scanloom.streaming.states import event_stream

#: Files of a micro-batch: all that are there.
EVERY_FILE = (1 << 31) - 1


def _mean(values: Column) -> Column:
    known = F.filter(values, lambda x: x.isNotNull())
    return F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))


@query("""
WITH f AS (SELECT p_partkey AS file, CASE WHEN p_size % 5 <> 0 THEN p_size ELSE 0 END AS n FROM part),
s AS (SELECT file, n, CASE WHEN n <= 12 THEN range(1, n + 1) ELSE list_slice(range(1, n + 1, greatest(1, n // 12)), 1, 12) END AS a, CASE WHEN n <= 8 THEN range(1, n + 1) ELSE list_slice(range(1, n + 1, greatest(1, n // 8)), 1, 8) END AS b FROM f WHERE n > 0),
p AS (SELECT file, a, b, unnest(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x)))) AS page, generate_subscripts(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), 1) AS i FROM s),
l AS (SELECT l_partkey AS file, l_orderkey % 50 + 1 AS page, max({'o': l_orderkey, 'gap': l_discount, 'tier': l_tax, 'line': l_linenumber, 'n': l_suppkey % 4}) AS m FROM lineitem GROUP BY 1, 2),
j AS (SELECT p.file, p.page, p.i, list_contains(a, p.page) AS one, list_contains(b, p.page) AS two, m,
        CASE WHEN m IS NULL OR m.line = 4 THEN 'fetch' WHEN m.line = 6 AND list_contains(a, p.page) THEN 'gap' WHEN m.line = 5 AND list_contains(b, p.page) THEN 'tier' WHEN m.line = 7 THEN 'columns' END AS failed,
        CASE WHEN m.gap = 0.1 AND m.line = 3 AND m.n = 0 THEN 'no page ' || p.page END AS client FROM p LEFT JOIN l USING (file, page)),
g AS (SELECT file, arg_min(client, i) FILTER (client IS NOT NULL) AS message, count(*) FILTER (failed IS NULL) AS measured, count(*) FILTER (failed IS NOT NULL) AS failed_pages,
        sum((m.gap * 100)::INT) FILTER (one AND failed IS NULL) AS gap, count(*) FILTER (one AND failed IS NULL) AS gaps, count(*) FILTER (two AND failed IS NULL) AS tiers,
        list(page ORDER BY page) FILTER (two AND coalesce(failed, 'columns') = 'columns') AS images, coalesce(sum(m.n) FILTER (failed IS NULL), 0) AS frame FROM j GROUP BY 1),
d AS (SELECT *, CASE WHEN gap > gaps * 5 AND tiers > 2 THEN 2 ELSE 1 END AS n_tiers, list_sum(images)::DOUBLE / len(images) AS ratio FROM g)
SELECT f.file, CASE WHEN message IS NULL THEN 'done' ELSE 'failed' END AS state, message, CASE WHEN message IS NULL THEN coalesce(n_tiers, 1) END::INT AS n_tiers, CASE WHEN message IS NULL THEN ratio END AS ratio,
       CASE WHEN message IS NULL THEN frame END::BIGINT AS frame, CASE WHEN message IS NULL AND list_max(images[:3])::DOUBLE <> ratio THEN list_max(images[:3])::DOUBLE END AS read_ratio, coalesce(measured, 0) AS measured, coalesce(failed_pages, 0) AS failed_pages
FROM f LEFT JOIN d USING (file)""")
def inspected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files, their lines as measures of pages; lines' numbers stand for failures."""
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), (F.col("p_size") % 5 != 0).alias("multi"), F.col("p_size").alias("pages"))
    line = F.col("m.line")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("file"), (F.col("l_orderkey") % 50 + 1).cast("int").alias("page"))
    lines = lines.agg(F.max(F.struct("l_orderkey", F.col("l_discount").alias("gap"), F.col("l_tax").alias("tier"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 4).alias("n"))).alias("m"))
    client = F.when((F.col("m.gap") == 0.1) & (line == 3) & (F.col("m.n") == 0), F.concat(F.lit("no page "), "page"))
    failed = F.when(line == 4, "fetch").when(line == 6, "gap").when(line == 5, "tier").when(line == 7, "columns")
    measures = lines.select("file", "page", F.concat_ws("/", "file", "page").alias("image"), "m.gap", "m.tier", F.col("m.n").alias("columns"), failed.alias("failed"), client.alias("client"))

    def decide(gaps: Column, tiers: Column) -> Column:
        hundredths = F.aggregate(F.filter(gaps, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + F.round(x * 100).cast("int"))
        two = (hundredths > F.size(F.filter(gaps, lambda x: x.isNotNull())) * 5) & (F.size(F.filter(tiers, lambda x: x.isNotNull())) > 2)
        return F.when(two, F.array(F.lit(0.5))).otherwise(F.array().cast("array<double>"))

    total = lambda values: F.aggregate(F.coalesce(values, F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)
    done = I.inspected(files, measures, decide, lambda pages, tiers: _mean(pages), total, lambda pages, ratio, tiers, frame: F.array_max(pages).cast("double"))
    return done.withColumn("n_tiers", (F.size("tiers") + 1).cast("int")).select("file", "state", "message", F.when(F.col("state") == "done", F.col("n_tiers")).alias("n_tiers"), "ratio", F.col("frame").cast("long").alias("frame"), "read_ratio", "measured", "failed_pages")


@query("""
SELECT file, ratio, tiers FROM (
  SELECT 'c' || c_custkey AS file, CASE WHEN c_mktsegment = 'BUILDING' THEN -c_acctbal ELSE c_acctbal END AS ratio, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END::BIGINT AS tiers FROM customer
  UNION ALL SELECT 's' || s_suppkey, s_acctbal, 2 FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_tax = 0.08))""")
def layout_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's last version after three saves: customers, a segment of them again, suppliers;
    a fourth, under rules to come, takes some suppliers' layouts out of this one's sight."""
    path = f"{shared_dir(spark)}/scanloom-store-{uuid.uuid4().hex}"
    tiers = lambda n: F.array_repeat(F.lit(0.5), n)
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("file"), F.col("c_acctbal").alias("ratio"), "c_mktsegment")
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("file"), F.col("s_acctbal").alias("ratio"), tiers(2).alias("tiers"))
    store.save(customers.select("file", "ratio", tiers(1).alias("tiers")), path, LAYOUT_VERSION)
    store.save(customers.filter("c_mktsegment = 'BUILDING'").select("file", (-F.col("ratio")).alias("ratio"), tiers(0).alias("tiers")), path, LAYOUT_VERSION)
    store.save(suppliers, path, LAYOUT_VERSION)
    later = table(spark, sf_dir, "lineitem").filter("l_quantity = 50 and l_tax = 0.08").select(F.concat(F.lit("s"), "l_suppkey").alias("file")).distinct()
    store.save(suppliers.join(later, "file", "left_semi"), path, LAYOUT_VERSION + 1)
    return store.load(spark, path, LAYOUT_VERSION).select("file", "ratio", F.size("tiers").cast("long").alias("tiers"))


def _fed(spark: SparkSession, sf_dir: str, path: str, parts: int = 4) -> Iterator[None]:
    """events as files for a stream to find, a part at a time: earlier times come first, as
    a watermark has it, and each part is written by as many tasks as read it."""
    events = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    step = F.coalesce(F.floor((at - low) * parts / (high - low + 1)), F.lit(0)) if low is not None else F.lit(0)
    for part in range(parts):
        events.filter(step == part).write.mode("append").parquet(f"{path}/in")
        yield


@query("""
WITH l AS (SELECT c_custkey AS file, c_acctbal AS ratio FROM customer WHERE c_mktsegment <> 'BUILDING'),
a AS (SELECT user_id AS file, event_id, l.ratio, CASE WHEN l.file IS NULL THEN 409 ELSE 200 END AS code FROM events LEFT JOIN l ON l.file = user_id)
SELECT 'answer' AS sink, file, event_id, ratio, code FROM a UNION ALL SELECT DISTINCT 'work', file, NULL::BIGINT, NULL::DOUBLE, NULL::INT FROM a WHERE code = 409""")
def pending_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sinks of a stream of requests, in four micro-batches."""
    path = f"{shared_dir(spark)}/scanloom-pending-{uuid.uuid4().hex}"
    layouts = lambda: table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("file"), F.col("c_acctbal").alias("ratio"))
    for _ in _fed(spark, sf_dir, path):
        asked = event_stream(spark, f"{path}/in", "*.parquet", EVERY_FILE).select(F.col("user_id").alias("file"), "event_id")
        pending.serve(asked, layouts, f"{path}/answers", f"{path}/work", f"{path}/checkpoint").awaitTermination()
    answers = spark.read.parquet(f"{path}/answers").select(F.lit("answer").alias("sink"), "file", "event_id", "ratio", "code")
    return answers.union(spark.read.parquet(f"{path}/work").select(F.lit("work"), "file", F.lit(None), F.lit(None), F.lit(None)))


@query("""
WITH RECURSIVE e AS (
  SELECT user_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' AND event_id % 40 = 0 THEN 'done' WHEN event_type = 'purchase' THEN 'other' ELSE 'request' END AS ev,
         epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events
), r AS (
  SELECT user_id, 0::BIGINT AS i, 'absent' AS state, NULL::BIGINT AS t, '' AS told, 0 AS began, 0 AS gone FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, i, CASE WHEN ev = 'request' THEN CASE was WHEN 'absent' THEN 'running' WHEN 'failed' THEN 'absent' ELSE was END WHEN was = 'running' AND ev IN ('failed', 'done') THEN ev ELSE was END, t,
         CASE WHEN ev = 'request' THEN CASE was WHEN 'absent' THEN 'running' ELSE was END ELSE '' END, CASE WHEN ev = 'request' AND was = 'absent' THEN 1 ELSE 0 END, quiet::INT
  FROM (SELECT e.user_id, e.i, e.ev, e.t, state = 'running' AND e.t - r.t > 43200000 AS quiet, CASE WHEN state = 'running' AND e.t - r.t > 43200000 THEN 'absent' ELSE state END AS was FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
), g AS (SELECT user_id, sum((told = 'running')::INT)::BIGINT AS running, sum((told = 'failed')::INT)::BIGINT AS failed, sum((told = 'done')::INT)::BIGINT AS done, sum(began)::BIGINT AS starts, sum(gone)::BIGINT AS expired, arg_max(state, i) AS state, max(t) AS t FROM r GROUP BY 1),
w AS (SELECT *, state = 'running' AND t + 43200000 < (SELECT max(epoch_ms(ts)) FROM events) AS quiet FROM g)
SELECT user_id AS file, CASE WHEN quiet THEN 'absent' ELSE state END AS state, running, failed, done, starts, expired + quiet::INT AS expired FROM w""")
def inspection_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's last state from a stream of its log; runs that are quiet for twelve hours expire."""
    path = f"{shared_dir(spark)}/scanloom-inspections-{uuid.uuid4().hex}"
    kind = F.when(F.col("event_type") == "error", "failed").when((F.col("event_type") == "purchase") & (F.col("event_id") % 40 == 0), "done").when(F.col("event_type") == "purchase", "other").otherwise("request")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timed.PROVIDER)
    try:
        sink = lambda rows, n: rows.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{path}/states/batch={n}")
        for _ in _fed(spark, sf_dir, path):
            log = event_stream(spark, f"{path}/in", "*.parquet", EVERY_FILE).select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), "ts", kind.alias("event"))
            timed.inspections(log, 12 * 3600).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    states = spark.read.parquet(f"{path}/states")
    # A batch may tell a file's state twice, after its events and after its timer.
    order = F.struct("n", "running", "failed", "done", "starts", "expired")
    return states.groupBy("file").agg(F.max_by(F.struct("state", *timed.COUNTS), order).alias("x")).select("file", "x.*")
