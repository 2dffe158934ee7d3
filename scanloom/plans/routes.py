"""Requests answered from body to response, over requests derived from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators import route
from scanloom.plans.register import query
from scanloom.sources.shared import written
from scanloom.sources.tables import table

MODELS = {"hangul": True, "hanmun": False}
TEN_DAYS = 10 * 24 * 3600
#: Events whose requests one task makes and parses.
TASK_EVENTS = 25_000


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def service(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metadata, fetched scans and layouts, a file for each customer."""
    c = table(spark, sf_dir, "customer").withColumn("file", F.concat(F.lit("scan "), F.col("c_custkey")))
    info = c.filter("c_acctbal > 0").select("file", (F.col("c_nationkey") % 3 != 0).alias("multi"), (F.col("c_nationkey") % 9).alias("pages"))
    pages = c.select("file", "c_nationkey", F.col("c_custkey").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("page")).filter("(c_nationkey + page) % 11 <> 0")
    images = pages.select("file", "page", (600 + F.col("k")).alias("width"), (800 + 100 * F.col("page")).alias("height"), F.concat_ws("-", "file", "page").alias("image"))
    own = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit(0.5))).otherwise(F.array().cast("array<double>"))
    layouts = c.filter("c_mktsegment <> 'BUILDING'").select("file", own.alias("tiers"), F.col("c_acctbal").alias("ratio"), F.lit(None).cast("double").alias("read_ratio"))
    return info, images, layouts


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each event: its type is the path, its number ``k`` and value the fields,
    and some numbers stand for what may go wrong."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.round("value").cast("long").alias("r"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    k, r, u, i = (F.col(c) for c in ("k", "r", "user_id", "event_id"))
    file = F.when(k == 97, "").when(k == 98, '"file": 7, ').otherwise(_text('"file": "File:scan_', u, '", '))
    page = F.when(i % 2 == 0, _text('"page": "', k % 9, '"')).otherwise(_text('"page": ', k % 9, ".0"))
    model = F.when(i % 50 == 7, ', "model": "x"').when(i % 6 == 0, "").when(i % 6 == 1, ', "model": ""').when(i % 6 == 3, ', "model": "hanmun"').when(i % 6 == 4, ', "model": null').otherwise(', "model": "hangul"')
    tiers = _text(', "tiers": ', F.when(k % 8 == 0, "null").otherwise((k % 8).cast("string")))
    limit = _text(', "threshold": ', F.when(r > 60, 1.5).otherwise((r % 3) / 2), F.when(i % 4 == 0, ', "spacing": false').otherwise(""))
    text = F.when(k % 5 == 0, "").otherwise(_text(', "text": "t', k, '"'))
    far = F.when(k % 20 == 13, "5000000000").when(k % 20 == 14, "9000000000000000000").when(k % 20 == 15, "1e30").otherwise((u + 10 * r).cast("string"))
    box = F.when(k % 20 == 11, "[1, 2, 3]").otherwise(_text("[", u, F.when(k % 20 == 12, ".5").otherwise(""), ", ", k, ", ", far, ", ", k + 200, "]"))
    ratio = F.when(k % 10 == 0, ', "ratio": -1').when(k % 10 == 1, "").otherwise(_text(', "ratio": ', (k % 10).cast("string")))
    size = F.when(k % 4 == 0, _text(', "width": ', 600 + u)).when(k % 4 == 1, ', "width": 1').otherwise("")
    fields = (
        F.when(F.col("event_type") == "view", _text(tiers, limit)).when(F.col("event_type") == "click", _text(tiers, text)).when(F.col("event_type") == "purchase", _text(', "boxes": [[0, 0, 10, 10], ', box, "]"))
        .when(F.col("event_type") == "error", _text(ratio, size)).otherwise(_text(', "x0": ', k, ', "x1": ', k + r))
    )
    body = F.when(k == 95, "[1]").when(k == 96, "{").otherwise(_text("{", file, page, model, fields, "}"))
    path = F.when(k == 92, "/api/none").when(F.col("event_type") == "view", "/api/read").when(F.col("event_type") == "click", "/api/compare").when(F.col("event_type") == "purchase", "/api/boxes").when(F.col("event_type") == "error", "/api/area-read").otherwise("/api/edge")
    # A file of small events is one task, and each makes a body that costs more than the event.
    # The number is given, as partitions are otherwise put together again by their bytes.
    return e.repartition(e.count() // TASK_EVENTS + 1, i).select(i.alias("req"), F.when(k == 93, "OPTIONS").when(k == 94, "GET").otherwise("POST").alias("method"), path.alias("path"), body.alias("body"), "at")


def stand_in(rows: DataFrame) -> DataFrame:
    """In place of recognition: it fails on page 7 of some files, and page 5 has a reason."""
    fails = (F.col("page") == 7) & F.col("file").endswith("9")
    return rows.withColumns({"answer": F.when(~fails, F.concat_ws("|", "op", "file", "page")), "reason": F.when(F.col("page") == 5, "blank")})


@query("""
WITH e AS (SELECT event_id AS req, user_id AS u, event_type AS ty, round(value)::BIGINT AS r, (props->>'k')::INT AS k, (props->>'k')::INT % 9 AS p, epoch_us(ts) AS t, event_id % 6 AS m,
             event_id % 4 = 0 AS tight, ts < TIMESTAMP '2024-01-16' AS early FROM events),
j AS (SELECT e.*, 'scan ' || u AS f, CASE ty WHEN 'view' THEN 'read' WHEN 'click' THEN 'compare' WHEN 'purchase' THEN 'boxes' WHEN 'error' THEN 'area-read' ELSE 'edge' END AS op,
        i.c_custkey IS NOT NULL AS known, i.c_nationkey AS nk, l.c_custkey IS NOT NULL AS laid, c.c_custkey IS NOT NULL AND p BETWEEN 1 AND 8 AND (c.c_nationkey + p) % 11 <> 0 AS scanned,
        CASE WHEN req % 50 = 7 THEN 'model' WHEN m = 3 THEN 'model_file' END AS wrong
      FROM e LEFT JOIN customer c ON c.c_custkey = u LEFT JOIN customer i ON i.c_custkey = u AND i.c_acctbal > 0 LEFT JOIN customer l ON l.c_custkey = u AND l.c_mktsegment <> 'BUILDING'),
a AS (SELECT *, CASE WHEN k % 20 = 11 THEN 'shape' WHEN k % 20 = 12 THEN 'coordinate' WHEN k % 20 IN (13, 14, 15) THEN 'limit' WHEN r <= 0 THEN 'order' WHEN (10 * r + 8) * 208 > 1048576 THEN 'limit' END AS box FROM j),
x AS (SELECT *, CASE
        WHEN k = 93 THEN 'options' WHEN k = 94 THEN 'method' WHEN k IN (95, 96) THEN 'body' WHEN k IN (97, 98) THEN 'file' WHEN p = 0 THEN 'page' WHEN k = 92 THEN 'path'
        WHEN op = 'read' AND r > 60 THEN 'threshold' WHEN op = 'compare' AND k % 5 = 0 THEN 'text' WHEN op = 'boxes' AND box IS NOT NULL THEN box
        WHEN op = 'edge' AND r <= 0 THEN 'order' WHEN op = 'edge' AND r < 24 THEN 'zoom'
        WHEN op IN ('read', 'compare') AND NOT laid THEN 'layout' WHEN op IN ('read', 'compare') AND k % 8 = 7 THEN 'tiers' WHEN op IN ('read', 'compare', 'area-read') AND wrong IS NOT NULL THEN wrong
        WHEN op = 'area-read' AND k % 10 = 0 THEN 'ratio' WHEN NOT known THEN 'missing' WHEN nk % 3 = 0 AND p <> 1 THEN 'page' WHEN nk % 3 <> 0 AND nk % 9 <> 0 AND p > nk % 9 THEN 'page' WHEN NOT scanned THEN 'scan'
        WHEN op = 'area-read' AND k % 4 = 1 THEN 'size' WHEN op = 'boxes' AND u + 10 * r > 600 + u THEN 'outside' WHEN op = 'edge' AND k + r > 600 + u THEN 'outside' WHEN op = 'boxes' AND wrong IS NOT NULL THEN wrong END AS error,
        CASE op WHEN 'read' THEN [u, p, k % 8, CASE WHEN r > 60 THEN -1 ELSE r % 3 END, tight::INT] WHEN 'compare' THEN [u, p, k % 8, k] ELSE [u, p, CASE WHEN k % 10 = 1 THEN 1 ELSE k % 10 END] END AS key FROM a),
s AS (SELECT op, key, max(t) + 864000000000 AS expires FROM x WHERE early AND error IS NULL AND op IN ('read', 'compare', 'area-read') AND p <> 5 AND NOT (p = 7 AND f LIKE '%9') GROUP BY 1, 2),
y AS (SELECT x.*, coalesce(NOT early AND error IS NULL AND s.expires > t, false) AS reused FROM x LEFT JOIN s ON s.op = x.op AND s.key = x.key),
z AS (SELECT *, CASE WHEN error IS NULL AND p = 7 AND f LIKE '%9' AND NOT reused THEN 'server' ELSE error END AS final FROM y)
SELECT req, CASE WHEN k <> 92 THEN op END AS op, CASE final WHEN 'options' THEN 204 WHEN 'method' THEN 404 WHEN 'path' THEN 404 WHEN 'layout' THEN 409 WHEN 'server' THEN 500 ELSE CASE WHEN final IS NULL THEN 200 ELSE 400 END END AS code,
       nullif(final, 'options') AS error, CASE WHEN op = 'boxes' AND (error = box OR error = 'outside') THEN 1 END::INT AS bad_pos, CASE WHEN k NOT IN (95, 96, 97, 98) THEN f END AS file, CASE WHEN k NOT IN (95, 96) AND p > 0 THEN p END::BIGINT AS page,
       reused, CASE WHEN final IS NULL THEN op || '|' || f || '|' || p END AS answer, final IS NULL AND NOT reused AND p <> 5 AND op IN ('read', 'compare', 'area-read') AS stored FROM z""")
def answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request's code, error and answer; those of the first half of the month are
    answered first, and what they store for ten days serves the others."""
    info, images, layouts = service(spark, sf_dir)
    asked = requests(spark, sf_dir)
    half = 1705363200 * 1_000_000  # 2024-01-16, UTC
    none = spark.createDataFrame([], "op string, image string, params string, expires long, answer string")
    answer = lambda rows, results: route.answered(rows, info, images, layouts, results, MODELS, stand_in, seconds=TEN_DAYS)
    first = written(answer(asked.filter(F.col("at") < half), none), "answers")
    second = answer(asked.filter(F.col("at") >= half), route.to_store(first))
    return first.union(second).select("req", "op", "code", "error", "bad_pos", "file", "page", "reused", "answer", F.col("expires").isNotNull().alias("stored"))
