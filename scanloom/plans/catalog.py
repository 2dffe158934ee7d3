"""Registered queries over whole tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.functions import scalar as S
from scanloom.operators import requests as Q
from scanloom.plans import bodies, inspections, joins, levels, pages, routes  # noqa: F401  they register their queries
from scanloom.plans.register import ORACLE_SQL, QUERIES, query  # noqa: F401
from scanloom.sources.tables import table

PUBLIC_HOST = "therha.example.com"
MARKS = [".", ",", "!", "?"]


@query("""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) p, count(*) OVER (PARTITION BY source) n FROM documents)
SELECT source, doc_id, p, n, substr(sha256(text), 1, 16) AS fingerprint,
       length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS utf16
FROM d WHERE n <= 12 OR ((p - 1) % greatest(1, n // 12) = 0 AND (p - 1) // greatest(1, n // 12) < 12)""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Q.even_sample(table(spark, sf_dir, "documents"), "source", ["doc_id"], 12)
    return docs.select("source", "doc_id", "p", "n", S.fingerprint(F.col("text")).alias("fingerprint"), S.utf16_length(F.col("text")).cast("long").alias("utf16"))


@query("""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
a AS (SELECT source, list_slice(range(1, n + 1, greatest(1, n // 12)), 1, 12) AS a, list_slice(range(1, n + 1, greatest(1, n // 8)), 1, 8) AS b FROM n)
SELECT source, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS pages FROM a""")
def ordered_union_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").cast("int").alias("n"))
    return n.select("source", F.array_join(F.array_union(Q.even_pages(F.col("n"), 12), Q.even_pages(F.col("n"), 8)).cast("array<string>"), ",").alias("pages"))


@query("""SELECT p_partkey, trim(p_name) AS name FROM part""")
def file_name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" File:파일:"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("\t"))
    return table(spark, sf_dir, "part").select("p_partkey", S.file_name(raw).alias("name"))


@query("""
WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l.l_orderkey AS file, sum(CASE WHEN CASE WHEN c.n % 2 = 0 THEN l_linenumber <= c.n ELSE l_linenumber = 1 END THEN 1 ELSE 0 END)::BIGINT AS present, count(*) AS asked
FROM lineitem l JOIN c USING (l_orderkey) GROUP BY 1""")
def page_exists_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("page"))
    info = asked.groupBy("file").agg(F.count("*").alias("pages")).withColumn("multi", F.col("pages") % 2 == 0)
    there = Q.page_exists(F.col("multi"), F.col("pages"), F.col("page"))
    return asked.join(info, "file").groupBy("file").agg(F.sum(there.cast("int")).alias("present"), F.count("*").alias("asked"))


@query("""
SELECT p_partkey, p_size % 6 + 1 AS n, coalesce(list_sum(list_transform(range(1, p_size % 6 + 1), lambda k: k / (p_size % 6 + 1))), 0.0) AS total, (p_size % 6)::BIGINT AS inner_n FROM part""")
def tier_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 6 + 1).alias("n")).withColumn("t", S.tiers(F.col("n")))
    return parts.select("p_partkey", "n", F.aggregate("t", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("t").cast("long").alias("inner_n"))


@query("""
SELECT l_returnflag AS flag, count(*) AS n, sum(round(CASE WHEN l_discount <> 0 THEN l_discount WHEN l_tax <> 0 THEN l_tax ELSE 1.0 END * 100))::BIGINT AS hundredths FROM lineitem GROUP BY 1""")
def ratio_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = S.first_nonzero(F.col("l_discount"), F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.sum(F.round(ratio * 100).cast("long")).alias("hundredths"))


@query("SELECT o_orderkey, printf('%04d.jpg', o_orderkey) AS name FROM orders")
def page_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", S.page_file(F.col("o_orderkey")).alias("name"))


@query("""
SELECT page_id, split_part(url, '?', 1) AS plain, split_part(split_part(url, '?', 1), '#', 1) || '/page{N}-1920px-' || page_id || '.jpg' AS template FROM pages""")
def url_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = S.without_query(F.col("url"))
    thumb = F.concat(F.substring_index(plain, "#", 1), F.lit("/page1-500px-"), F.col("page_id"), F.lit(".jpg"))
    return table(spark, sf_dir, "pages").select("page_id", plain.alias("plain"), S.url_template(thumb).alias("template"))


@query("""
SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) = 'therha.example.com' AS allowed FROM pages""")
def host_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", S.host(url).alias("host"), S.host_allowed(url, PUBLIC_HOST).alias("allowed"))


@query("""SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]+)', 1), '') AS page, nullif(regexp_extract(url, '[?&]utm_source=([^&#]+)', 1), '') AS utm FROM pages""")
def query_first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", S.query_value(url, "page").alias("page"), S.query_value(url, "utm_source").alias("utm"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes derived from lineitem: requests are orders, places follow a total order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    x0, y0 = (F.col("l_partkey") % 500).cast("int"), (F.col("l_suppkey") % 300).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("req"), F.row_number().over(w).alias("pos"), x0.alias("x0"), y0.alias("y0"),
        (x0 + F.col("l_quantity").cast("int") * 40 - 40).alias("x1"), (y0 + (F.col("l_linenumber") * 180)).alias("y1"),
    )


@query("""
WITH b AS (
  SELECT l_orderkey AS req, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS pos,
         (l_quantity::INT * 40 - 40)::BIGINT AS w, l_linenumber * 180 AS h FROM lineitem
), s AS (SELECT *, (w + 8) * (h + 8) AS area, sum((w + 8) * (h + 8)) OVER (PARTITION BY req ORDER BY pos ROWS UNBOUNDED PRECEDING) AS total FROM b),
j AS (SELECT *, CASE WHEN w <= 0 OR h <= 0 THEN 'order' WHEN area > 1048576 THEN 'box' WHEN total > 16777216 THEN 'total' END AS reason FROM s)
SELECT req, count(*) AS n_boxes, min(pos) FILTER (reason IS NOT NULL) AS bad_pos, coalesce(arg_min(reason, pos) FILTER (reason IS NOT NULL), 'ok') AS reason FROM j GROUP BY req""")
def box_running_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.box_limits(_boxes(spark, sf_dir), "req", "pos")


@query("""
WITH b AS (SELECT (l_partkey % 500)::INT AS x0, ((l_partkey % 500) + l_quantity::INT * 4 - 8)::INT AS x1, (l_linenumber * 4000)::INT AS h FROM lineitem),
j AS (SELECT CASE WHEN x0 < 0 OR x0 >= x1 THEN 'order' WHEN 96.0::DOUBLE / (x1 - x0) > 4 THEN 'zoom' WHEN x1 > 600 THEN 'width' WHEN greatest(8.0, round_even(h * (96.0::DOUBLE / (x1 - x0)), 0)) > 8192 THEN 'height' ELSE 'ok' END AS verdict FROM b)
SELECT verdict, count(*) AS n FROM j GROUP BY 1""")
def edge_scale_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0 = (F.col("l_partkey") % 500).cast("int")
    x1 = (x0 + F.col("l_quantity").cast("int") * 4 - 8).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(x0.alias("x0"), x1.alias("x1"), (F.col("l_linenumber") * 4000).alias("h"))
    safe = F.when(F.col("x1") == F.col("x0"), F.col("x0") - 1).otherwise(F.col("x1"))
    return rows.withColumn("x1", safe).groupBy(S.edge_verdict(F.col("x0"), F.col("x1"), F.lit(600), F.col("h")).alias("verdict")).agg(F.count("*").alias("n"))


@query("""
SELECT event_type, sum(CASE WHEN event_id % 10 <> 0 AND value / 100 BETWEEN 0 AND 1 THEN 1 ELSE 0 END)::BIGINT AS valid, count(*) AS n FROM events GROUP BY 1""")
def threshold_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 100)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(S.finite_in(t, 0, 1).cast("int")).alias("valid"), F.count("*").alias("n"))


@query("""SELECT doc_id, length(translate(text, '.,!?', '')) AS chars, substr(sha256(translate(text, '.,!?', '')), 1, 16) AS fingerprint FROM documents""")
def punct_filter_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.translate("text", "".join(MARKS), "")
    return table(spark, sf_dir, "documents").withColumn("kept", kept).select("doc_id", F.length("kept").cast("long").alias("chars"), S.fingerprint(F.col("kept")).alias("fingerprint"))


@query("""SELECT user_id, count(*) AS n, sum(CASE WHEN value < 50 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS flagged FROM events GROUP BY 1""")
def flag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = F.coalesce(F.sum((F.col("value") < 50).cast("int")) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), flagged.alias("flagged"))


@query("""SELECT conv_id, count(*) AS turns, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1""")
def text_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))


@query("""SELECT doc_id, sha256(text) AS full_hash, substr(sha256(text), 1, 12) AS short_hash, substr(sha1(source), 1, 16) AS folder FROM documents""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", S.fingerprint(text, 64).alias("full_hash"), S.fingerprint(text, 12).alias("short_hash"), F.substring(F.sha1(F.col("source").cast("binary")), 1, 16).alias("folder"))


@query("""
WITH d AS (SELECT doc_id, regexp_replace(text, 'e', chr(128512), 'g') AS t FROM documents)
SELECT doc_id, length(t) + (length(t) - length(replace(t, chr(128512), ''))) AS whole, length(t[:50]) + (length(t[:50]) - length(replace(t[:50], chr(128512), ''))) AS at_50 FROM d""")
def utf16_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace("text", F.lit("e"), F.lit("\U0001f600"))
    docs = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return docs.select("doc_id", S.utf16_length(F.col("t")).cast("long").alias("whole"), S.utf16_offset(F.col("t"), F.lit(50)).cast("long").alias("at_50"))


@query("""SELECT user_id, max(event_id) AS last FROM events GROUP BY 1 ORDER BY last DESC LIMIT 6""")
def lru6_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.lru_keys(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("""
WITH f AS (SELECT user_id AS key, max(ts) AS mtime FROM events GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY mtime, key) rn, count(*) OVER () c FROM f)
SELECT key, mtime FROM n WHERE c > 40 AND rn <= c - 40 + 10""")
def disk_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = Q.last_access(table(spark, sf_dir, "events").withColumnRenamed("user_id", "key"), "key", "ts")
    return Q.evicted_files(files, 40, 10).select("key", "mtime")


@query("""
WITH RECURSIVE e AS (SELECT user_id, epoch(ts)::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (
  SELECT user_id, i, t + 86400 AS expires, 0 AS hit FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.i, CASE WHEN e.t < r.expires THEN r.expires ELSE e.t + 86400 END, CASE WHEN e.t < r.expires THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1
)
SELECT user_id, count(*) AS requests, sum(hit)::BIGINT AS hits FROM r GROUP BY 1""")
def ttl_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return Q.ttl_hits(log, "user_id", "event_id", "t", 86400)


@query("""SELECT event_id, round(value, 3) AS seconds, round(value / 7, 6) AS stage FROM events""")
def stage_timing_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round("value", 3).alias("seconds"), F.round(F.col("value") / 7, 6).alias("stage"))


@query("""SELECT CASE WHEN label % 3 = 0 THEN 'hangul' ELSE 'model' || label END AS model, count(*) AS n, (CASE WHEN label % 3 = 0 OR label < 5 THEN 'known' ELSE 'unknown' END) AS status FROM embeddings GROUP BY 1, 3""")
def model_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.select(F.when(F.col("label") % 3 == 0, "").otherwise(F.concat(F.lit("model"), F.col("label"))).alias("model"))
    registry = vectors.filter("label < 5 and label % 3 <> 0").select(F.concat(F.lit("model"), F.col("label")).alias("name")).distinct().union(vectors.select(F.lit("hangul")).limit(1))
    status = F.when(F.col("name").isNull(), "unknown").otherwise("known")
    return Q.with_default(asked, "model", registry, "name", "hangul").groupBy("model", status.alias("status")).agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT n_nationkey AS idx, n_name AS ch FROM nation)
SELECT c.c_custkey AS cell, t.ch AS lead, v.ch AS vowel FROM customer c JOIN t ON t.idx = c.c_nationkey JOIN t v ON v.idx = (c.c_custkey % 25)""")
def index_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), F.col("n_name").alias("ch"))
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").cast("long").alias("l"), (F.col("c_custkey") % 25).alias("v"))
    lead, vowel = t.select(F.col("idx").alias("l"), F.col("ch").alias("lead")), t.select(F.col("idx").alias("v"), F.col("ch").alias("vowel"))
    return cells.join(lead, "l").join(vowel, "v").select("cell", "lead", "vowel")


@query("""SELECT doc_id, source AS file, n_chars, CASE WHEN n_chars > 0 THEN sha256(text) END AS ocr_hash, substr(text, 1, 20) AS head FROM documents""")
def provenance_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    ocr = F.when(F.col("n_chars") > 0, F.struct(S.fingerprint(F.col("text"), 64).alias("hash"), F.substring("text", 1, 20).alias("head")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), "n_chars", ocr.alias("ocr"))
    return rows.select("doc_id", "file", "n_chars", F.col("ocr.hash").alias("ocr_hash"), F.col("ocr.head").alias("head"))


@query("""SELECT d.doc_id, count(*) AS found, min(b.item_id) AS first_item FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1""")
def compare_pipeline_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected passages found verbatim, wherever they start and whatever their length."""
    hits = Q.containing(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id")
    return hits.groupBy("doc_id").agg(F.count("*").alias("found"), F.min("item_id").alias("first_item"))
