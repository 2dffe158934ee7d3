"""Operators against plain Python models on edge cases and random inputs."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scanloom.functions import bodies as B
from scanloom.functions import scalar as S
from scanloom.operators import recognise as R
from scanloom.operators import requests as Q
from scanloom.sources import tables
from scanloom.streaming import states


def test_even_sample_matches_a_slice(spark):
    rows = [(n * 100 + k, i) for n in (1, 4, 5, 7, 9, 23, 40) for k in (0, 1, 5, 12) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int")
    for k in (0, 1, 5, 12):
        got = {}
        for r in Q.even_sample(df.filter(F.col("g") % 100 == k), "g", ["i"], k).collect():
            got.setdefault(r["g"] // 100, []).append(r["p"])
        for n, pages in got.items():
            every = list(range(1, n + 1))
            assert sorted(pages) == (every if k <= 0 or n <= k else every[:: max(1, n // k)][:k])


@pytest.mark.parametrize(("raw", "want"), [("File:파일:x_y ", "x y"), ("파일:File:x", "File:x"), ("　a\t", "a"), (" File: b", "b"), ("", "")])
def test_file_name(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(S.file_name(F.col("x"))).first()[0] == want


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first()["x"]
    assert pick(S.page_file(F.lit(12345))) == "12345.jpg" and pick(S.page_file(F.lit(7))) == "0007.jpg"
    assert pick(S.page_number(F.lit(" 3 "))) == 3 and pick(S.page_number(F.lit("0"))) is None and pick(S.page_number(F.lit("3.0"))) is None
    assert pick(S.tiers(F.lit(1))) == [] and pick(S.tiers(F.lit(4))) == [0.25, 0.5, 0.75]
    assert pick(S.first_nonzero(F.lit(0.0), F.lit(None).cast("double"), F.lit(2.5))) == 2.5
    assert pick(S.finite_in(F.lit(float("nan")), 0, 1)) is False and pick(S.finite_in(F.lit(1.0), 0, 1)) is True
    assert pick(S.utf16_length(F.lit("a😀b"))) == 4 and pick(S.utf16_offset(F.lit("a😀b"), F.lit(2))) == 3
    assert pick(S.query_value(F.lit("http://a/?a=&a=2%20x&b=1#a=9"), "a")) == "2 x" and pick(S.query_value(F.lit("http://a/"), "a")) is None
    assert pick(S.host_allowed(F.lit("https://pub.example:443/x"), "pub.example")) is True
    assert pick(S.host_allowed(F.lit("https://pub.example:80/x"), "pub.example")) is False
    assert pick(S.host_allowed(F.lit("https://u@localhost/"), "pub.example")) is False
    assert pick(S.edge_verdict(F.lit(0), F.lit(24), F.lit(30), F.lit(10))) == "ok" and pick(S.edge_verdict(F.lit(0), F.lit(23), F.lit(30), F.lit(10))) == "zoom"


def test_page_exists(spark):
    rows = [(False, 1, 1, True), (False, 1, 2, False), (True, 0, 99, True), (True, 5, 5, True), (True, 5, 6, False), (True, 5, 0, False)]
    df = spark.createDataFrame(rows, "m boolean, n int, p int, want boolean")
    assert df.filter(Q.page_exists(F.col("m"), F.col("n"), F.col("p")) != F.col("want")).count() == 0


def test_box_limits_against_a_loop(spark):
    rng, rows, want = random.Random(3), [], {}
    for req in range(200):
        total = 0
        for pos in range(rng.randint(1, 25)):
            w, h = rng.choice([0, 5, 1016, 1017, 900]), rng.choice([1016, 800])
            rows.append((req, pos, 0, 0, w, h))
            total += (w + 8) * (h + 8)
            bad = "order" if w <= 0 else "box" if (w + 8) * (h + 8) > Q.PIXELS_EACH else "total" if total > Q.PIXELS_ALL else None
            if bad and req not in want:
                want[req] = (pos, bad)
    got = Q.box_limits(spark.createDataFrame(rows, "req int, pos int, x0 int, y0 int, x1 int, y1 int"), "req", "pos").collect()
    assert {r["req"]: (r["bad_pos"], r["reason"]) for r in got if r["reason"] != "ok"} == want


def test_eviction_keeps_the_newest(spark):
    files = spark.createDataFrame([(f"f{i:03}", float(i // 3)) for i in range(60)], "key string, mtime double")
    assert Q.evicted_files(files, 60, 10).count() == 0
    want = sorted((i // 3, f"f{i:03}") for i in range(60))[: 60 - 50 + 10]
    assert sorted((r["mtime"], r["key"]) for r in Q.evicted_files(files, 50, 10).collect()) == want


def test_inspection_log_against_a_loop(spark):
    """Hot files and null files pass through in small batches."""
    rng, rows, want = random.Random(5), [], {}
    for f in (1, 2, None, 3):
        for seq in range(600 if f == 1 else 40):
            rows.append((f, seq, rng.choice(["request", "request", "failed", "other"] + ["done"] * (seq > 30))))
    for f in (1, 2, None, 3):
        state, told = "absent", Counter()
        for _, _, e in (r for r in rows if r[0] == f):
            if e == "request":
                told["running" if state == "absent" else state] += 1
                told["starts"] += state == "absent"
                state = {"absent": "running", "failed": "absent"}.get(state, state)
            elif state == "running" and e in ("failed", "done"):
                state = e
        want[f] = (told["running"], told["failed"], told["done"], told["starts"], state)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r[0]: tuple(r)[1:] for r in Q.inspection_log(spark.createDataFrame(rows, "file long, seq long, event string"), "file", "seq", "event").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_no_group_is_held_in_one_place(spark):
    """Long groups pass through in small batches; the plans hold no whole group."""
    rng = random.Random(9)
    rows = [(u, i, float(i * 5 + rng.randint(0, 4))) for i in range(4000) for u in ([0, 1, None] if i % 3 else [0, 2])]
    log = spark.createDataFrame(rows, "u long, seq long, t double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        hits = Q.ttl_hits(log, "u", "seq", "t", 60)
        got = {r["u"]: (r["requests"], r["hits"]) for r in hits.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for u in (0, 1, 2, None):
        expires, n, want = -1.0, 0, 0
        for _, _, t in sorted((r for r in rows if r[0] == u), key=lambda r: r[1]):
            n += 1
            if t < expires:
                want += 1
            else:
                expires = t + 60
        assert got[u] == (n, want)
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "collect_list" not in plan(hits)


def test_even_sample_ranks_without_the_other_columns(spark):
    rows = [(g, i // 2 if g == 1 else i, f"text {i}") for g, n in ((0, 3000), (1, 500), (2, 3), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int, text string").repartition(5)
    sample = Q.even_sample(df, "g", ["i"], 12)
    assert sample.columns == ["g", "i", "text", "p", "n"]
    got = {}
    for r in sample.collect():
        got.setdefault((r["g"], r["n"]), []).append((r["p"], r["i"], r["text"]))
    for g, n in ((0, 3000), (1, 500), (2, 3), (None, 40)):
        picks = sorted(got[g, n])
        assert [p for p, _, _ in picks] == (list(range(1, n + 1))[:: max(1, n // 12)][:12])
        assert all(i == ((p - 1) // 2 if g == 1 else p - 1) and (g == 1 or t == f"text {i}") for p, i, t in picks)
    assert not re.search(r"row_number\(\) windowspecdefinition\(g#\d+, i#\d+ ASC", sample._jdf.queryExecution().toString())


def test_bodies_and_layouts(spark, tmp_path):
    bodies = ['{"page": 3}', "", "  ", "[1]", "{", "null"]
    got = spark.createDataFrame([(b,) for b in bodies], "b string").select(F.to_json(tables.body(F.col("b"))).alias("x")).collect()
    assert [r["x"] for r in got] == ['{"page":3}', "{}", None, None, None, None]
    (tmp_path / "l.json").write_text("\n".join(json.dumps({"file": f, "ver": v}) for f, v in (("a", 5), ("b", 4))) + "\n{broken")
    assert [r["file"] for r in tables.layouts(spark, str(tmp_path)).collect()] == ["a"]


def test_scans_and_stored_layouts(spark, tmp_path):
    (tmp_path / "img").mkdir()
    for name in ("a.jpg", "b.png", "c.JPG", "d.png.part"):
        (tmp_path / "img" / name).write_bytes(b"x")
    assert sorted(r["path"][-5:] for r in tables.scans(spark, str(tmp_path / "img")).collect()) == ["a.jpg", "b.png"]
    rows = spark.createDataFrame([("f", [0.5], 1.5), ("g", [], None)], "file string, tiers array<double>, ratio double")
    for _ in range(2):
        tables.save_layouts(rows, str(tmp_path / "layouts"))
    got = tables.layouts(spark, str(tmp_path / "layouts")).orderBy("file").collect()
    assert [(r["file"], r["tiers"], r["ratio"], r["ver"]) for r in got] == [("f", [0.5], 1.5, 5), ("g", [], None, 5)]


def test_pages_keep_their_rows_when_empty(spark):
    rows = [(1, [None, (["a", ",", "b"], [0.1, 0.2, 0.9], [[0], [1], [2]])], True), (2, [None], False), (3, None, True), (4, [([","], [0.5], [[0]])], True)]
    df = spark.createDataFrame(rows, "p int, lines array<struct<ch: array<string>, conf: array<double>, box: array<array<int>>>>, geometry boolean")
    kept = df.withColumn("lines", R.kept_lines(F.col("lines"), [","]))
    assert kept.filter("p = 1").select(F.to_json("lines").alias("x")).first()["x"] == '[{"ch":["a","b"],"conf":[0.1,0.9],"box":[[0],[2]]}]'
    none = F.array().cast("array<string>")
    got = {r["p"]: r["v"] for r in kept.select("p", R.verdict(F.col("lines"), F.lit(0.5), F.lit("good"), none, F.col("geometry")).alias("v")).collect()}
    assert (got[1]["grade"], got[1]["text"], got[1]["marked_share"], got[1]["chars"]) == ("good", "ab", 0.5, 2)
    assert (got[2]["grade"], got[2]["reasons"], got[2]["chars"], got[2]["boxes"], got[2]["marked_share"]) == (R.UNUSABLE, [R.NOTHING_READ], None, 0, 0.0)
    assert got[3]["grade"] == got[4]["grade"] == "good" and got[3]["text"] == got[4]["text"] == ""


@pytest.mark.parametrize(("boxes", "want"), [
    ("[]", (0, None, None)), ("7", (None, None, "boxes")), ("[[0,0,1,1]]", (1, None, None)), ("[[0,0,1,1],[0,0,1]]", (None, 1, "shape")), ("[5]", (None, 0, "shape")),
    ('[["0",0,1,1]]', (None, 0, "coordinate")), ("[[0.0,0,1e0,1]]", (1, None, None)), ("[[0.5,0,1,1]]", (None, 0, "coordinate")), ("[[1,0,1,1]]", (None, 0, "order")), ("[[-1,0,1,1]]", (None, 0, "order")),
    ("[[0,0,1016,1016]]", (1, None, None)), ("[[0,0,1017,1016]]", (None, 0, "limit")), ("[" + ",".join(["[0,0,1016,1016]"] * 16) + "]", (16, None, None)), ("[" + ",".join(["[0,0,1016,1016]"] * 17) + "]", (None, 16, "limit")),
    ("[" + ",".join(["[0,0,1,1]"] * 20_000) + "]", (20_000, None, None)), ("[" + ",".join(["[0,0,1,1]"] * 20_001) + "]", (None, None, "count")),
])
def test_box_lists(spark, boxes, want):
    df = spark.createDataFrame([(boxes,)], "x string").select(F.parse_json("x").alias("x"))
    r = B.box_list(df, "x").first()
    assert (None if r["boxes"] is None else len(r["boxes"]), r["bad_pos"], r["error"]) == want


@pytest.mark.parametrize(("proto", "host", "want"), [
    ("http", "[::1]:8080", "http://[::1]:8080/"), ("http", "localhost:99999", None), ("http", "localhost:65535", "http://localhost:65535/"), ("http", "localhost:", None), ("http", "localhost:x", None),
    ("http", "Pub.Example", "https://pub.example/"), ("http", "pub.example:443", "https://pub.example:443/"), ("http", "pub.example:0443", "https://pub.example:0443/"), ("https", "pub.example:80", None),
    ("ftp", "localhost", None), ("http", "a@localhost", None), ("http", "localhost/", None), ("http", "localhost\n", None), ("http", "[::2]", None), ("http", "", None), ("http", "::1", None), ("HTTP", "localhost", None),
])
def test_base_address(spark, proto, host, want):
    host = host.replace("\\n", "\n")
    row = spark.createDataFrame([(proto, host)], "p string, h string")
    assert row.select(S.base_address(F.col("p"), F.col("h"), "pub.example").alias("x")).first()["x"] == want


def test_containing_finds_short_items_and_those_inside_words(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 3)))
    docs = [(i, rng.choice(["", "  ", "(", "x"]) + rng.choice([" ", "\t", "  "]).join(word() for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(99, None)]
    items = []
    for k in range(60):
        text = rng.choice(docs[:80])[1]
        a = rng.randint(0, len(text))
        items.append((k, text[a : a + rng.randint(1, 60)] or "zz"))
    d, b = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame([*items, (90, None)], "item long, text string")
    got = sorted((r["doc"], r["item"]) for r in Q.containing(d, "doc", b, "item").collect())
    assert got == sorted((i, k) for i, t in docs if t is not None for k, x in items if x in t)


def test_streams_match_batches(spark, tmp_path):
    from scanloom.plans.catalog import table

    events = states.event_stream(spark, "/root/testdata/sf0.001")
    q = states.windowed(events).writeStream.format("memory").queryName("win").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = table(spark, "/root/testdata/sf0.001", "events")
    assert spark.sql("select sum(n) n from win").first()["n"] == batch.count()
    spark.createDataFrame([("a", e) for e in ("request", "failed", "request", "request", "done")], "file string, event string").coalesce(1).write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema("file string, event string").parquet(str(tmp_path / "in"))
    q = states.inspections(log).writeStream.format("memory").queryName("insp").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("select * from insp").first()
    assert (r["state"], r["told"]) == ("done", "running,failed,running")
