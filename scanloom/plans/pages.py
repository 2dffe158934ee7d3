"""Queries whose requests, addresses and texts are those of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import scalar as S
from scanloom.operators import recognise as R
from scanloom.plans.register import query
from scanloom.sources import tables
from scanloom.sources.tables import table

MARKS = [".", ",", "!", "?"]


@query("""
WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS proto, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages),
m AS (SELECT min(host) AS public FROM u)
SELECT page_id, CASE WHEN host = public THEN 'https://' || host || '/' END AS address, CASE WHEN host = public THEN 200 ELSE 400 END AS code,
       CASE WHEN host = public THEN 'https://' || host || ':443/' END AS with_port, 400 AS plain_port, proto || '://localhost/' AS local FROM u, m""")
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's protocol and host as a request's own, where the first of all hosts is the
    service's: as it is, with the port of https and of http, and for a local host."""
    url = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("proto"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))
    public = url.agg(F.min(F.lower("host"))).first()[0]
    none = F.lit("")
    own = lambda host: S.own_address(none, none, host, none, F.col("proto"), public)
    asked = url.select("page_id", own(F.col("host")).alias("a"), own(F.concat("host", F.lit(":443"))).alias("b"), own(F.concat("host", F.lit(":80"))).alias("c"), own(F.lit("localhost")).alias("d"))
    return asked.select("page_id", "a.address", "a.code", F.col("b.address").alias("with_port"), F.col("c.code").alias("plain_port"), F.col("d.address").alias("local"))


@query("""
WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, title FROM (SELECT page_id, url, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), 'none') AS title FROM pages))
SELECT page_id, path || '/' || title || '+' AS path, ends_with(path, '.html') AS scan FROM u""")
def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's path with its title, percent-encoded and its UTF-8 read as Latin-1, decoded
    again; and whether the path names a scan once .html is .jpg."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"), F.coalesce(F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")), F.lit("none")).alias("title"))
    half = F.floor(F.length("title") / 2).cast("int")
    coded = F.replace(F.url_encode(F.substring("title", F.lit(1), half)), F.lit("+"), F.lit("%20"))
    raw = F.decode(F.encode(F.concat("path", F.lit("/"), coded, F.replace(F.substring("title", half + 1, F.length("title")), F.lit("%"), F.lit("%25")), F.lit("+")), "UTF-8"), "ISO-8859-1")
    return pages.select("page_id", S.decoded_path(raw).alias("path"), S.is_scan(F.regexp_replace("path", r"\.html$", ".jpg")).alias("scan"))


@query("""
SELECT event_id, CASE WHEN value < 1 THEN 400 ELSE 200 END AS code, CASE WHEN value >= 1 THEN (props->>'k')::BIGINT END AS k, CASE WHEN value >= 1 THEN '{"k":' || (props->>'k') || ',"t":[1,{"a":"' || event_type || '","b":2}]}' END AS canonical FROM events""")
def event_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties as request bodies, cut short where the value is under one, with
    more fields in no order; and as a canonical text."""
    more = F.concat(F.lit('{"t": [1, {"b": 2, "a": "'), "event_type", F.lit('"}],'), F.substring("props", F.lit(2), F.length("props")))
    body = tables.body(F.when(F.col("value") < 1, F.substring(more, F.lit(1), F.length(more) - 1)).otherwise(more))
    rows = table(spark, sf_dir, "events").select("event_id", body.alias("b"))
    return rows.select("event_id", F.when(F.col("b").isNull(), 400).otherwise(200).alias("code"), F.try_variant_get("b", "$.k", "long").alias("k"), S.canonical(F.col("b")).alias("canonical"))


@query("""
WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
k AS (SELECT conv_id, n, string_agg(translate(text, '.,!?', ''), '|' ORDER BY i DESC) FILTER (CASE WHEN conv_id % 3 = 0 THEN true ELSE i % 2 = 0 END AND length(text) % 5 <> 0) AS down,
        string_agg(translate(text, '.,!?', ''), '|' ORDER BY i) FILTER (length(text) % 5 <> 0) AS up FROM t GROUP BY 1, 2)
SELECT conv_id, substr(sha256(coalesce(CASE WHEN conv_id % 3 = 0 THEN up ELSE down END, '')), 1, 16) AS fingerprint, CASE WHEN n > 4 THEN '1' END AS blank, CASE WHEN n > 4 THEN 0.25 ELSE 1.0 END::DOUBLE AS first_ratio FROM k""")
def trimmed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages whose edges were trimmed to every other line, the last first,
    or not at all; lines of a length that five divides were not read.  Long pages have a
    blank tier and ratios of their own."""
    chars = lambda t: F.split(t, "")
    line = lambda x: F.when(F.length(x["text"]) % 5 != 0, F.struct(chars(x["text"]).alias("ch"), F.transform(chars(x["text"]), lambda c: F.lit(0.5)).alias("conf"), F.transform(chars(x["text"]), lambda c, i: F.array(i, i)).alias("box")))
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    last = F.size("t") - 1
    left = F.when(F.col("conv_id") % 3 != 0, F.sequence(last - F.pmod(last, F.lit(2)), F.lit(0), F.lit(-2)))
    kept = R.kept_lines(F.transform("t", line), MARKS, left)
    text = F.array_join(F.transform(kept, lambda x: F.array_join(x["ch"], "")), "|")
    blank = F.when(F.size("t") > 4, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    geometry = F.struct(blank.alias("blank"), F.array(F.lit(0.5)).alias("tiers"), F.lit(1.0).alias("pitch"), F.lit(2.0).alias("xpitch"), F.array(F.lit(0.25), F.lit(2.0)).alias("tier_ratios"))
    layout = R.seen_layout(F.struct(F.array().cast("array<double>").alias("tiers"), F.lit(1.0).alias("ratio")), geometry)
    rows = pages.select("conv_id", S.fingerprint(text).alias("fingerprint"), layout.alias("l"))
    first = F.coalesce(F.get("l.tier_ratios", F.lit(0)), "l.ratio")
    return rows.select("conv_id", "fingerprint", F.array_join(F.col("l.blank").cast("array<string>"), ",").alias("blank"), first.alias("first_ratio"))


@query("""
WITH d AS (SELECT doc_id, source, lang, n_chars, length(text) AS n, text FROM documents)
SELECT doc_id, CASE WHEN n < 200 THEN 'short' END AS reason, 1920 AS width, CASE WHEN n >= 200 THEN n / (n + 100) END AS agreement, CASE WHEN n >= 200 THEN n // 50 END AS wavering, CASE WHEN n >= 200 THEN lang || ':' || source END AS title,
       CASE WHEN n >= 200 THEN n END AS chars, CASE WHEN n >= 200 THEN 2 END AS attempts, CASE WHEN n >= 200 THEN substr(sha256(text), 1, 16) END AS ocr_hash, 'b1' AS build FROM d""")
def compared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole responses to comparisons, with what a comparison (here a stand-in) found."""
    docs, n = table(spark, sf_dir, "documents"), F.length("text")
    reason = F.when(n < 200, "short")
    attempts = F.array(F.lit("plain"), F.lit("inked"))
    debug = R.diagnosis(F.col("source"), F.col("doc_id"), F.lit("https://x/{N}.jpg"), F.col("source"), F.col("text"), F.split("text", ""), reason, size=F.struct(F.lit(1920).alias("width"), F.lit(1080).alias("height")), build=F.lit("b1"), attempts=attempts)
    candidates = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end")))
    title = F.concat_ws(":", "lang", "source")
    r = R.compare_response(reason, debug, F.col("text"), candidates, F.col("lang"), agreement=n / (n + 100), wavering=F.floor(n / 50), title=title, chars=n.cast("long"), attempts=attempts)
    rows = docs.select("doc_id", r.alias("r"))
    return rows.select("doc_id", "r.reason", "r.debug.size.width", "r.agreement", "r.wavering", "r.title", "r.chars", F.when(F.col("r.attempts").isNotNull(), F.size("r.attempts")).alias("attempts"), F.col("r.debug.ocr.hash").alias("ocr_hash"), "r.debug.build")


@query("""
SELECT 'v1' AS build, 4 AS threads, 'shared' AS cache, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS inspected,
       (SELECT string_agg(r_name || '=' || n, ',' ORDER BY r_name) FROM (SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)) AS models""")
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service's own report, over files that have measures and models that have parts."""
    there = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    models = there.agg(F.sort_array(F.collect_list(F.struct("r_name", F.col("n").cast("string").alias("n")))).alias("m"))  # as many as regions
    inspected = table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_orderkey").alias("inspected"))
    report = R.health(F.lit("v1"), F.lit(4), F.lit("shared"), F.col("inspected"), F.map_from_entries("m"))
    row = inspected.crossJoin(models).select(report.alias("h"))  # one row each
    listed = F.array_join(F.transform(F.array_sort(F.map_keys("h.models")), lambda k: F.concat(k, F.lit("="), F.col("h.models")[k])), ",")
    return row.select("h.build", "h.threads", "h.cache", "h.inspected", listed.alias("models"))
