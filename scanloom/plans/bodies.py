"""Queries over request bodies, lookups and response shaping.

The driver's tables hold no requests, so each query derives them from its table's rows, every
rule's edge cases among them; the SQL states the expected outcome of each case by itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import bodies as B
from scanloom.functions import scalar as S
from scanloom.operators import recognise as R
from scanloom.operators import requests as Q
from scanloom.plans.register import query
from scanloom.sources import tables
from scanloom.sources.shared import shared_dir
from scanloom.sources.tables import table

PUBLIC_HOST = "therha.example.com"
MARKS = [".", ",", "!", "?"]
THRESHOLD = 0.5


def case(n: Column, *values) -> Column:
    """The n-th of the values."""
    out = F
    for i, v in enumerate(values):
        out = out.when(n == i, v if isinstance(v, Column) else F.lit(v))
    return out


def as_body(text: Column) -> Column:
    return tables.body(text)


@query("""
WITH c AS (SELECT p_partkey, p_name, p_partkey % 14 AS c FROM part)
SELECT p_partkey,
       CASE c WHEN 0 THEN trim(p_name) WHEN 1 THEN 'File:x y' WHEN 12 THEN 'a b' ELSE CASE WHEN c NOT IN (9, 10, 13) THEN 'a' END END AS file,
       CASE c WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 6 THEN 1 WHEN 7 THEN 10 WHEN 9 THEN 2 WHEN 10 THEN 1 WHEN 13 THEN 1 END::BIGINT AS page,
       CASE WHEN c IN (9, 10, 13) THEN 'file' WHEN c IN (3, 4, 5, 8, 11, 12) THEN 'page' END AS error
FROM c""")
def request_file_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat(F.lit('{"file": " File:파일:'), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit('\\t", "page": 3}'))
    bodies = case(
        F.col("p_partkey") % 14, named, '{"file": "", "파일": " 파일:File:x y ", "쪽": "2"}', '{"file": "a", "page": 3.0}', '{"file": "a", "page": 2.5}',
        '{"file": "a", "page": true}', '{"file": "a", "page": null, "쪽": 4}', '{"file": "a"}', '{"file": "a", "page": " 1_0 "}', '{"file": "a", "page": 0}',
        '{"page": 2}', '{"file": 7}', '{"file": "a", "page": "3.0"}', '{"file": "a_b", "page": [1]}', '{"file": "  _ ", "page": 1}',
    )
    return B.file_and_page(table(spark, sf_dir, "part").select("p_partkey", as_body(bodies).alias("body")), "body").drop("body")


@query("""
WITH c AS (SELECT p_partkey, p_retailprice, CASE p_partkey % 11 WHEN 4 THEN 1 WHEN 5 THEN 3 WHEN 6 THEN 4 WHEN 7 THEN 2 WHEN 8 THEN 1 WHEN 9 THEN -1 WHEN 10 THEN -1 END AS n FROM part)
SELECT p_partkey, n = -1 AS refused, CASE WHEN n <> -1 OR n IS NULL THEN coalesce(n - 1, 1)::BIGINT END AS inner_n,
       CASE WHEN n IS NULL THEN 0.5 WHEN n > 0 THEN coalesce(list_sum(list_transform(range(1, n), lambda k: k / n)), 0.0) END AS total, p_retailprice AS ratio
FROM c""")
def tier_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = F.concat(F.lit("{"), case(F.col("p_partkey") % 11, "", '"tiers": null', '"tiers": "auto"', '"tiers": "자동"', '"tiers": 1', '"tiers": 3', '"tiers": " 4 "', '"tiers": 2.7', '"tiers": true', '"tiers": 7', '"tiers": "x"'), F.lit("}"))
    n = B.tier_count(B.field(as_body(bodies), "tiers"))
    layout = F.struct(F.array(F.lit(0.5)).alias("tiers"), F.col("p_retailprice").alias("ratio"))
    rows = table(spark, sf_dir, "part").select("p_partkey", n.alias("n"), layout.alias("layout")).withColumn("layout", B.with_tiers(F.col("layout"), F.col("n")))
    fine = F.coalesce(F.col("n") != -1, F.lit(True))
    total = F.aggregate("layout.tiers", F.lit(0.0), lambda a, x: a + x)
    return rows.select("p_partkey", (F.col("n") == -1).alias("refused"), F.when(fine, F.size("layout.tiers").cast("long")).alias("inner_n"), F.when(fine, total).alias("total"), F.col("layout.ratio").alias("ratio"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1) THEN o_custkey WHEN o_orderkey % 7 = 6 THEN -o_custkey END AS x FROM orders""")
def coordinate_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_custkey").cast("string")
    given = case(F.col("o_orderkey") % 7, n, F.concat(n, F.lit(".0")), F.concat(n, F.lit(".5")), F.concat(F.lit('"'), n, F.lit('"')), "true", "null", F.concat(F.lit("-"), n, F.lit("e0")))
    return table(spark, sf_dir, "orders").select("o_orderkey", B.coordinate(F.try_parse_json(given)).alias("x"))


@query("""
WITH b AS (
  SELECT l_orderkey AS req, row_number() OVER w - 1 AS pos, l_partkey % 500 AS x0, l_suppkey % 300 AS y0, l_partkey % 500 + l_quantity::BIGINT * 40 - 40 AS x1, l_suppkey % 300 + l_linenumber * 180 AS y1,
         CASE WHEN l_suppkey % 17 = 0 THEN 'shape' WHEN l_partkey % 19 = 0 THEN 'coordinate' END AS broken
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)
), s AS (SELECT *, (x1 - x0 + 8) * (y1 - y0 + 8) AS area, sum((x1 - x0 + 8) * (y1 - y0 + 8)) OVER (PARTITION BY req ORDER BY pos ROWS UNBOUNDED PRECEDING) AS total FROM b),
j AS (SELECT *, coalesce(broken, CASE WHEN x0 >= x1 OR y0 >= y1 THEN 'order' WHEN area > 1048576 OR total > 16777216 THEN 'limit' END) AS error FROM s),
r AS (SELECT req, count(*) AS n, arg_min(error, pos) FILTER (error IS NOT NULL) AS error, min(pos) FILTER (error IS NOT NULL) AS bad_pos, min(pos) FILTER (x1 > 1200 OR y1 > 900) AS outside FROM j GROUP BY 1)
SELECT req, CASE WHEN error IS NULL THEN n END AS boxes, error, bad_pos::INT AS bad_pos, CASE WHEN error IS NULL THEN outside END::INT AS outside FROM r""")
def box_list_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    x0, y0 = F.col("l_partkey") % 500, F.col("l_suppkey") % 300
    x1, y1 = x0 + F.col("l_quantity").cast("long") * 40 - 40, y0 + F.col("l_linenumber") * 180
    mark = F.when(F.col("l_partkey") % 19 == 0, ".5").when(F.col("l_partkey") % 5 == 0, ".0").otherwise("")
    box = F.when(F.col("l_suppkey") % 17 == 0, F.lit("[1, 2, 3]")).otherwise(F.concat(F.lit("["), x0, mark, F.lit(", "), y0, F.lit(", "), x1, F.lit(", "), y1, F.lit("]")))
    # A request is one body, so an order's boxes are one text.
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("req")).agg(F.sort_array(F.collect_list(F.struct(*order, box.alias("box")))).alias("b"))
    body = F.concat(F.lit('{"boxes": ['), F.array_join(F.transform("b", lambda x: x["box"]), ", "), F.lit("]}"))
    checked = B.box_list(lists.select("req", B.field(as_body(body), "boxes").alias("given")), "given")
    return checked.select("req", F.size("boxes").cast("long").alias("boxes"), "error", "bad_pos", B.first_outside(F.col("boxes"), F.lit(1200), F.lit(900)).alias("outside"))


@query("""
WITH c AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 9 IN (2, 3) AND o_custkey = 0 THEN 8 ELSE o_orderkey % 9 END AS c FROM orders)
SELECT o_orderkey, CASE c WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN o_custkey / 8 WHEN 3 THEN o_custkey / 8 WHEN 4 THEN 1.0 END::DOUBLE AS ratio,
       CASE WHEN c > 4 THEN 'ratio' WHEN c IN (3, 4) AND o_custkey % 10 <> 0 THEN 'reload' ELSE 'ok' END AS verdict
FROM c""")
def area_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_custkey") / 8).cast("string")
    w = (F.col("o_custkey") % 10).cast("string")
    body = case(
        F.col("o_orderkey") % 9, "{}", '{"ratio": null}', F.concat(F.lit('{"ratio": '), n, F.lit("}")), F.concat(F.lit('{"ratio": " '), n, F.lit('", "width": '), w, F.lit("}")), F.concat(F.lit('{"ratio": true, "height": '), w, F.lit("}")),
        '{"ratio": "nan"}', '{"ratio": -1}', '{"ratio": [1]}', '{"ratio": "1e999"}',
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", as_body(body).alias("b"))
    r = B.ratio(B.field(F.col("b"), "ratio"))
    differs = B.size_differs(B.coordinate(B.field(F.col("b"), "width")), B.coordinate(B.field(F.col("b"), "height")), F.lit(0), F.lit(0))
    return rows.select("o_orderkey", r.alias("ratio"), F.when(r.isNull(), "ratio").when(differs, "reload").otherwise("ok").alias("verdict"))


@query("""
WITH c AS (SELECT event_id, round(value) AS v, event_id % 8 AS c FROM events)
SELECT event_id, CASE WHEN c = 0 THEN 0.5 WHEN c = 1 AND v <= 100 THEN v / 100 WHEN c = 2 AND v <= 100 THEN v / 100 WHEN c = 3 THEN 1.0 WHEN c = 7 THEN 0.0 END AS threshold, c <> 1 AS spacing FROM c""")
def read_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.round("value") / 100).cast("string")
    body = case(
        F.col("event_id") % 8, '{"spacing": null}', F.concat(F.lit('{"threshold": '), v, F.lit(', "spacing": false}')), F.concat(F.lit('{"threshold": "'), v, F.lit('", "spacing": 0}')), '{"threshold": 1}',
        '{"threshold": true}', '{"threshold": 1.01, "spacing": "false"}', '{"threshold": null}', '{"threshold": 0.0}',
    )
    rows = table(spark, sf_dir, "events").select("event_id", as_body(body).alias("b"))
    return rows.select("event_id", B.threshold(B.field(F.col("b"), "threshold"), THRESHOLD).alias("threshold"), B.spacing(F.col("b")).alias("spacing"))


@query("""
SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 6 IN (0, 1, 2) THEN length(text) WHEN (conv_id + turn) % 6 = 3 THEN 0 END AS chars, (conv_id + turn) % 6 > 3 AS missing FROM conversations""")
def compare_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = S.json_string(F.col("text"))
    body = case(
        (F.col("conv_id") + F.col("turn")) % 6, F.concat(F.lit('{"text": '), quoted, F.lit("}")), F.concat(F.lit('{"본문": '), quoted, F.lit("}")), F.concat(F.lit('{"text": null, "본문": '), quoted, F.lit("}")),
        '{"text": "", "본문": "x"}', '{"text": 3, "본문": "x"}', "{}",
    )
    text = B.body_text(as_body(body))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(text).cast("long").alias("chars"), text.isNull().alias("missing"))


@query("""
WITH c AS (SELECT page_id, page_id % 20 AS c FROM pages)
SELECT page_id, CASE c WHEN 0 THEN 'http://localhost/' WHEN 1 THEN 'https://therha.example.com/' WHEN 2 THEN 'https://therha.example.com:443/' WHEN 4 THEN 'http://[::1]:8080/' WHEN 5 THEN 'http://127.0.0.1:5000/'
         WHEN 9 THEN 'https://base.example/ocr/' WHEN 11 THEN 'https://localhost/' WHEN 18 THEN 'http://localhost:1/' END AS address,
       CASE WHEN c IN (0, 1, 2, 4, 5, 9, 11, 18) THEN 200 WHEN c IN (10, 19) THEN 500 ELSE 400 END AS code FROM c""")
def own_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        ("", "", "", "", "http"), ("", "", "Therha.Example.com", "", "http"), ("", "therha.example.com:443", "localhost", "https", "http"), ("", "", "therha.example.com:80", "", "http"),
        ("", "", "[::1]:8080", "", "http"), ("", "127.0.0.1:5000", "evil.example", "", "http"), ("", "", "localhost:99999", "", "http"), ("", "", "evil.example", "", "http"),
        ("", "", "localhost:", "", "http"), ("https://base.example/ocr//", "evil.example", "", "", "http"), ("ftp://base.example", "", "localhost", "", "http"), ("", "", "localhost", "https", "http"),
        ("", "", "localhost", "ftp", "http"), ("", "", "u@localhost", "", "http"), ("", "", "localhost\n", "", "http"), ("", "", "localhost/x", "", "http"), ("", "", "[::2]", "", "http"),
        ("", "", "localhost:0", "", "http"), ("", "", "LOCALHOST:1", "", "http"), ("https://-bad-.example", "", "localhost", "", "http"),
    ]
    # First as columns, as the address takes each several times.
    given = table(spark, sf_dir, "pages").select("page_id", *(case(F.col("page_id") % 20, *(r[i] for r in rows)).alias(f"_{i}") for i in range(5)))
    return given.select("page_id", S.own_address(*(F.col(f"_{i}") for i in range(5)), PUBLIC_HOST).alias("x")).select("page_id", "x.*")


@query("""
SELECT page_id, CASE page_id % 7 WHEN 0 THEN '/영역/' || page_id WHEN 1 THEN '/café' WHEN 2 THEN '/a+b c' WHEN 3 THEN '/100%zz%' WHEN 4 THEN '/옛한글' WHEN 5 THEN '/영역' ELSE '/' END AS path FROM pages""")
def path_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    latin = lambda text: text.encode().decode("latin-1")
    path = case(F.col("page_id") % 7, F.concat(F.lit(latin("/영역/")), F.col("page_id")), "/café", "/a+b%20c", "/100%zz%", "/%EC%98%9B한글", "/영역", "/")
    return table(spark, sf_dir, "pages").select("page_id", S.decoded_path(path).alias("path"))


@query("""
WITH i AS (SELECT p_partkey, p_size % 3 <> 0 AS multi, p_size % 7 AS pages FROM part WHERE p_partkey % 10 <> 0),
j AS (SELECT l.l_partkey AS file, CASE WHEN i.p_partkey IS NULL THEN 'missing' WHEN (NOT multi AND l_linenumber <> 1) OR (multi AND pages <> 0 AND l_linenumber > pages) THEN 'page' ELSE 'ok' END AS reason, l_linenumber AS page
      FROM lineitem l LEFT JOIN i ON i.p_partkey = l.l_partkey)
SELECT file, reason, CASE WHEN reason = 'ok' THEN 200 ELSE 400 END AS code, count(*) AS asked, max(page)::INT AS last FROM j GROUP BY 1, 2""")
def request_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = table(spark, sf_dir, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("file"), (F.col("p_size") % 3 != 0).alias("multi"), (F.col("p_size") % 7).alias("pages"), F.lit("x").alias("template"))
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("page"))
    return Q.with_metadata(asked, info, "file", "page").groupBy("file", "reason", "code").agg(F.count("*").alias("asked"), F.max("page").cast("int").alias("last"))


@query("""
WITH l AS (SELECT c_custkey AS file, c_acctbal AS ratio FROM customer WHERE c_nationkey % 3 <> 0)
SELECT o.o_custkey AS file, CASE WHEN l.file IS NULL THEN 409 ELSE 200 END AS code, count(*) AS asked, any_value(l.ratio) AS ratio FROM orders o LEFT JOIN l ON l.file = o.o_custkey GROUP BY 1, 2""")
def layout_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    layouts = table(spark, sf_dir, "customer").filter("c_nationkey % 3 <> 0").select(F.col("c_custkey").alias("file"), F.col("c_acctbal").alias("ratio"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"))
    return Q.with_layout(asked, layouts, "file").groupBy("file", "code").agg(F.count("*").alias("asked"), F.first("ratio").alias("ratio"))


@query("""SELECT DISTINCT o_custkey AS file FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 3 <> 0)""")
def layout_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    layouts = table(spark, sf_dir, "customer").filter("c_nationkey % 3 <> 0").select(F.col("c_custkey").alias("file"))
    return Q.to_inspect(table(spark, sf_dir, "orders"), layouts, "o_custkey")


@query("""
WITH e AS (SELECT event_type AS op, user_id, event_id, event_id % 2 AS stored, epoch_us(ts) AS t, event_id % 5 = 0 AS failed FROM events),
r AS (SELECT op, user_id, max(t + 3600000000) AS expires FROM e WHERE stored = 1 AND NOT failed GROUP BY 1, 2)
SELECT e.op, count(*) AS asked, sum(CASE WHEN r.expires > e.t THEN 1 ELSE 0 END)::BIGINT AS reused FROM e LEFT JOIN r USING (op, user_id) WHERE stored = 0 GROUP BY 1""")
def cached_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (even events) against the results that others stored for an hour; a result
    with a reason (every fifth) is not stored."""
    image = S.fingerprint(F.col("user_id").cast("string"), 64)
    params = S.fingerprint(S.json_list(F.array(S.json_string(F.col("event_type")), F.col("user_id").cast("string"))), 64)
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), image.alias("image"), params.alias("params"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    stored = e.filter("event_id % 2 = 1 and event_id % 5 <> 0").select("op", "image", "params", (F.col("t") + 3_600_000_000).alias("expires"))
    asked = Q.with_results(e.filter("event_id % 2 = 0"), stored, ["op", "image", "params"], "t")
    return asked.groupBy("op").agg(F.count("*").alias("asked"), F.sum(F.col("reused").cast("int")).alias("reused"))


@query("""
SELECT p_partkey, sha256('["' || p_name || '", ' || p_size || ', {"단": [0.5], "자간비": ' || p_retailprice || '}, "hangul", ' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END || ']') AS params FROM part""")
def param_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = F.concat(F.lit('{"단": [0.5], "자간비": '), F.col("p_retailprice").cast("string"), F.lit("}"))
    key = S.json_list(F.array(S.json_string(F.col("p_name")), F.col("p_size").cast("string"), layout, S.json_string(F.lit("hangul")), F.when(F.col("p_size") % 2 == 0, "true").otherwise("false")))
    return table(spark, sf_dir, "part").select("p_partkey", S.fingerprint(key, 64).alias("params"))


@query("""
WITH s AS (SELECT p_partkey, p_size, list_slice(range(1, p_size + 1, greatest(1, p_size // 12)), 1, 12) AS a, list_slice(range(1, p_size + 1, greatest(1, p_size // 8)), 1, 8) AS b FROM part),
m AS (SELECT *, list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))) AS pages, p_partkey % 50 + 1 AS bad FROM s)
SELECT p_partkey, array_to_string(pages, ',') AS pages, len(list_filter(a, lambda x: x <> bad)) AS first, len(list_filter(b, lambda x: x <> bad)) AS second,
       array_to_string(list_filter(b, lambda x: x <> bad), ',') AS with_image, list_avg(list_transform(list_filter(b, lambda x: x <> bad), lambda x: (x * 37 % 11)::DOUBLE)) AS ratio FROM m""")
def inspection_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that an inspection of each part's ``p_size`` pages measures, where one fails,
    and the mean of a stand-in measure over those with an image."""
    failing = F.array((F.col("p_partkey") % 50 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", Q.inspected_pages(F.col("p_size"), failing).alias("x"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    total = F.aggregate("x.with_image", F.lit(0.0), lambda a, p: a + p * 37 % 11)
    return rows.select(
        "p_partkey", joined("x.pages").alias("pages"), F.size("x.first").cast("long").alias("first"), F.size("x.second").cast("long").alias("second"),
        joined("x.with_image").alias("with_image"), (total / F.nullif(F.size("x.with_image"), F.lit(0))).alias("ratio"),
    )


@query("""
WITH RECURSIVE e AS (
  SELECT user_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' AND event_id % 40 = 0 THEN 'done' WHEN event_type = 'purchase' THEN 'other' ELSE 'request' END AS ev,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events
), r AS (
  SELECT user_id, 0::BIGINT AS i, 'absent' AS state, '' AS told, 0 AS began FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.i,
         CASE WHEN ev = 'request' THEN CASE state WHEN 'absent' THEN 'running' WHEN 'failed' THEN 'absent' ELSE state END WHEN state = 'running' AND ev IN ('failed', 'done') THEN ev ELSE state END,
         CASE WHEN ev = 'request' THEN CASE state WHEN 'absent' THEN 'running' ELSE state END ELSE '' END, CASE WHEN ev = 'request' AND state = 'absent' THEN 1 ELSE 0 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1
)
SELECT user_id, sum((told = 'running')::INT)::BIGINT AS running, sum((told = 'failed')::INT)::BIGINT AS failed, sum((told = 'done')::INT)::BIGINT AS done, sum(began)::BIGINT AS starts, arg_max(state, i) AS state FROM r GROUP BY 1""")
def inspection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failed").when((F.col("event_type") == "purchase") & (F.col("event_id") % 40 == 0), "done").when(F.col("event_type") == "purchase", "other").otherwise("request")
    return Q.inspection_log(table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("event")), "user_id", "event_id", "event")


def _lines(text: Column, turn: Column) -> Column:
    """A turn as a page line of parallel arrays, null for every fifth turn."""
    chars = F.split(text, "")
    conf = F.transform(chars, lambda c: (F.ascii(c) * 37 % 101) / 100)
    box = F.transform(chars, lambda c, i: F.array(i, i * 2, i + 1, i * 2 + 2))
    return F.when(turn % 5 != 0, F.struct(chars.alias("ch"), conf.alias("conf"), box.alias("box")))


@query("""
WITH c AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM conversations WHERE turn % 5 <> 0),
k AS (SELECT * FROM c WHERE ch NOT IN ('.', ',', '!', '?')),
n AS (SELECT conv_id, sum((turn % 5 <> 0)::INT)::BIGINT AS lines FROM conversations GROUP BY 1)
SELECT n.conv_id, n.lines, count(k.ch) AS chars, coalesce(sum(unicode(ch) * 37 % 101), 0)::BIGINT AS hundredths, coalesce(sum(i * 2 + 2), 0)::BIGINT AS last_edges,
       substr(sha256(coalesce(string_agg(ch, '' ORDER BY turn, i), '')), 1, 16) AS fingerprint
FROM n LEFT JOIN k ON n.conv_id = k.conv_id GROUP BY 1, 2""")
def area_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages, a turn a column of text: null columns and marks go from all
    parallel arrays alike; confidences and characters of all columns."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    lines = pages.select("conv_id", R.kept_lines(F.transform("t", lambda t: _lines(t["text"], t["turn"])), MARKS).alias("lines"))
    hundredths = F.aggregate(R.confidences(F.col("lines")), F.lit(0).cast("long"), lambda a, c: a + F.round(c * 100).cast("long"))
    edges = F.aggregate(F.flatten(F.transform("lines", lambda x: x.box)), F.lit(0).cast("long"), lambda a, b: a + b[3])
    text = R.characters(F.col("lines"))
    return lines.select("conv_id", F.size("lines").cast("long").alias("lines"), F.size(text).cast("long").alias("chars"), hundredths.alias("hundredths"), edges.alias("last_edges"), S.fingerprint(F.array_join(text, "")).alias("fingerprint"))


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE translate(coalesce(text, ''), '.,!?', '') END AS t FROM documents),
c AS (SELECT doc_id, unicode(unnest(string_split(t, ''))) * 37 % 101 AS conf FROM d WHERE t <> ''),
n AS (SELECT doc_id, count(*) AS n, sum((conf < 50)::INT) AS low FROM c GROUP BY 1)
SELECT d.doc_id, CASE WHEN n IS NULL AND d.doc_id % 2 = 0 THEN '못씀' ELSE 'g' || d.doc_id % 3 END AS grade,
       CASE WHEN d.doc_id % 4 = 1 THEN 'faint' WHEN n IS NULL THEN '읽어 내지 못했습니다' ELSE '' END AS reasons,
       substr(sha256(t), 1, 16) AS fingerprint, coalesce(low::DOUBLE / n, 0.0) AS marked_share, coalesce(n, 0) AS boxes, n AS chars,
       CASE WHEN d.doc_id % 5 = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS first_tier, CASE WHEN d.doc_id % 5 = 0 THEN 1.5 ELSE 1.0 END::DOUBLE AS ratio
FROM d LEFT JOIN n ON n.doc_id = d.doc_id""")
def read_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of one column (every ninth empty), graded by a stand-in."""
    ident = F.col("doc_id")
    text = F.translate(F.coalesce("text", F.lit("")), "".join(MARKS), "")
    chars = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    line = F.struct(chars.alias("ch"), F.transform(chars, lambda c: (F.ascii(c) * 37 % 101) / 100).alias("conf"))
    lines = F.when(ident % 9 == 0, F.lit(None)).otherwise(F.array(line))
    reasons = F.when(ident % 4 == 1, F.array(F.lit("faint"))).otherwise(F.array().cast("array<string>"))
    v = R.verdict(F.col("lines"), F.lit(THRESHOLD), F.concat(F.lit("g"), (ident % 3).cast("string")), reasons, ident % 2 != 0)
    geometry = F.struct(F.when(ident % 5 == 0, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")).alias("blank"), F.array(F.lit(0.25)).alias("tiers"), F.lit(3.0).alias("pitch"), F.lit(2.0).alias("xpitch"))
    layout = F.struct(F.array(F.lit(0.5)).alias("tiers"), F.lit(1.0).alias("ratio"))
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).select("doc_id", v.alias("v"), R.blank_tiers(layout, geometry).alias("l"))
    return rows.select(
        "doc_id", "v.grade", F.array_join("v.reasons", ",").alias("reasons"), S.fingerprint(F.col("v.text")).alias("fingerprint"), "v.marked_share", "v.boxes", "v.chars", F.get("l.tiers", F.lit(0)).alias("first_tier"), F.col("l.ratio").alias("ratio"),
    )


@query("""
WITH d AS (SELECT doc_id, source, replace(text, 'e', chr(128512)) AS t, length(text) AS n, doc_id % 4 = 0 AS bad FROM documents)
SELECT doc_id, CASE WHEN bad THEN 'blank' END AS reason, 'https://x/page' || doc_id || '-1920px-a.jpg' AS address, substr(sha256(source), 1, 16) AS cache,
       CASE WHEN NOT bad THEN length(t) END AS ocr_count, CASE WHEN NOT bad THEN substr(sha256(t), 1, 16) END AS ocr_hash,
       CASE WHEN NOT bad THEN length(t[:n // 3]) + length(t[:n // 3]) - length(replace(t[:n // 3], chr(128512), '')) END AS start_at,
       CASE WHEN NOT bad THEN length(t) + length(t) - length(replace(t, chr(128512), '')) END AS end_at FROM d""")
def compare_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to comparisons of documents with letters beyond U+FFFF put in: two
    candidates each, and none where there is a reason not to compare."""
    text, n = F.col("t"), F.length("t")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.replace("text", F.lit("e"), F.lit("\U0001f600")).alias("t"))
    reason = F.when(F.col("doc_id") % 4 == 0, "blank")
    candidates = F.array(F.struct(F.floor(n / 3).cast("int").alias("start"), n.alias("end")), F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
    debug = R.diagnosis(F.col("source"), F.col("doc_id"), F.lit("https://x/page{N}-1920px-a.jpg"), F.col("source"), F.col("t"), F.split("t", ""), reason)
    rows = docs.select("doc_id", R.compare_response(reason, debug, text, candidates, F.lit("body")).alias("r"))
    at = F.get("r.candidates", F.lit(0))
    return rows.select("doc_id", "r.reason", "r.debug.address", "r.debug.cache", F.col("r.debug.ocr.count").alias("ocr_count"), F.col("r.debug.ocr.hash").alias("ocr_hash"), at["start"].cast("long").alias("start_at"), at["end"].cast("long").alias("end_at"))


@query("""
WITH t AS (SELECT n_regionkey AS model, n_nationkey % 3 AS part, string_agg('"' || n_name || '"', ', ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1, 2),
m AS (SELECT model, '[' || string_agg('[' || coalesce(names, '') || ']', ', ' ORDER BY part) || ']' AS json, count(*) AS parts FROM (SELECT m.model, p.part, t.names FROM (SELECT DISTINCT model FROM t) m CROSS JOIN (VALUES (0), (1), (2)) p(part) LEFT JOIN t ON t.model = m.model AND t.part = p.part) GROUP BY 1)
SELECT model, substr(sha256(json), 1, 12) AS fingerprint FROM m""")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's three character tables, here names of nations, as one short hash."""
    cells = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("model")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("cells"))

    def part(k: int) -> Column:
        return S.json_list(F.transform(F.filter("cells", lambda c: c["n_nationkey"] % 3 == k), lambda c: S.json_string(c["n_name"])))

    return cells.select("model", S.fingerprint(S.json_list(F.array(part(0), part(1), part(2))), 12).alias("fingerprint"))


@query("""
WITH n AS (SELECT l_orderkey, count(*) AS total, max(l_linenumber) AS done FROM lineitem GROUP BY 1)
SELECT l_orderkey, least(done, total) || '/' || total || '쪽' AS progress FROM n""")
def progress_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total"), F.max("l_linenumber").cast("long").alias("done"))
    return n.select("l_orderkey", S.progress_text(F.col("done"), F.col("total")).alias("progress"))


@query("""
SELECT (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'signup') AS inspected, (SELECT sum(strlen(props))::BIGINT FROM events) AS cached_bytes,
       (SELECT string_agg(r_name, ',' ORDER BY r_regionkey) FROM region WHERE r_regionkey = 0 OR r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey > 20)) AS models""")
def service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files inspected, bytes of stored results, and the models there are: the default one
    always, others only with their files (here nations numbered above 20)."""
    events = table(spark, sf_dir, "events").agg(F.count_distinct(F.when(F.col("event_type") == "signup", F.col("user_id"))).alias("inspected"), F.sum(F.octet_length("props")).cast("long").alias("cached_bytes"))
    files = table(spark, sf_dir, "nation").filter("n_nationkey > 20").select(F.col("n_regionkey").alias("r_regionkey"), F.lit(True).alias("_there")).distinct()
    models = table(spark, sf_dir, "region").join(files, "r_regionkey", "left").filter("r_regionkey = 0 or _there")
    names = models.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda m: m["r_name"]), ",").alias("models"))
    return events.crossJoin(names)  # one row each


@query("""SELECT o_orderkey, o_orderkey % 5 IN (0, 1) AS scan FROM orders""")
def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("f/"), F.col("o_orderkey"), case(F.col("o_orderkey") % 5, ".jpg", ".png", ".JPG", ".png.part", ".jpg\n"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.is_scan(name).alias("scan"))


@query("""
SELECT page_id, CASE WHEN page_id % 8 IN (0, 1) THEN 200 ELSE 400 END AS code, CASE page_id % 8 WHEN 0 THEN page_id END AS page FROM pages""")
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = case(F.col("page_id") % 8, F.concat(F.lit('{"page": '), F.col("page_id"), F.lit("}")), "", "  ", "[1]", "{", "null", F.concat(F.lit('{"a": "'), F.repeat(F.lit("x"), 5_000_000), F.lit('"}')), '"x"')
    b = as_body(body)
    return table(spark, sf_dir, "pages").select("page_id", F.when(b.isNotNull(), 200).otherwise(400).alias("code"), F.try_variant_get(b, "$.page", "long").alias("page"))


@query("""SELECT c_custkey::VARCHAR AS file, c_acctbal AS ratio, CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS tiers FROM customer""")
def layout_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts stored under the current rule version and loaded again."""
    path = f"{shared_dir(spark)}/scanloom-layouts-{uuid.uuid4().hex}"
    own = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit(0.5))).otherwise(F.array().cast("array<double>"))
    tables.save_layouts(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("file"), own.alias("tiers"), F.col("c_acctbal").alias("ratio")), path)
    return tables.layouts(spark, path).select("file", "ratio", F.size("tiers").cast("long").alias("tiers"))
