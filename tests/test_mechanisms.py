"""Folds over ordered events, joins by time and by overlap, and the whole route, against
plain Python models."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scanloom.functions import bodies as B
from scanloom.operators import folds, intervals, route
from scanloom.operators import requests as Q
from scanloom.operators.asof import asof_join
from scanloom.operators.intervals import interval_join
from scanloom.operators.within import totals_within
from scanloom.plans import joins, routes


def logged(events):
    told, starts, state = Counter(), 0, "absent"
    for e in events:
        state, answer = Q.inspection_step(state, e)
        if answer:
            told[answer[0]] += 1
            starts += answer[1]
    return told["running"], told["failed"], told["done"], starts, state


@pytest.mark.parametrize(("rows", "maps"), [(folds.RANGE_ROWS, folds.RANGE_MAPS), (300, 4)])
def test_inspection_log_is_cut_anywhere(spark, rows, maps):
    """A file with nine tenths of 3,000 events, a null one, events that mean nothing and null ones."""
    rng, log = random.Random(2), []
    for i in range(3000):
        file = "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None, *map(str, range(20))])
        log.append((file, i, rng.choice(["request", "request", "failed", "done" if i > 2500 else "failed", "other", None])))
    df = spark.createDataFrame(rng.sample(log, len(log)), "file string, seq long, event string").repartition(3)
    by = defaultdict(list)
    for f, _, e in log:
        by[f].append(e)
    got = {r["file"]: tuple(r)[1:] for r in Q.inspection_log(df, "file", "seq", "event", rows=rows, maps=maps).collect()}
    assert got == {f: logged(e) for f, e in by.items()}
    assert Q.inspection_log(df.limit(0), "file", "seq", "event").count() == 0


def test_maps_compose_in_any_grouping():
    to, seen = Q.INSPECTION.tables()
    rng = random.Random(3)
    which = [rng.randrange(4) for _ in range(100)]
    import numpy as np

    for runs in ([100], [1] * 100, [3, 50, 1, 46], [64, 36]):
        a, b = folds.composed(to[which], seen[which], np.array(runs))
        again = folds.composed(a, b, np.array([len(runs)]))
        for s, state in enumerate(Q.INSPECTION.states):
            now, counts = state, Counter()
            for w in which:
                if w < 3:
                    now, names = Q.INSPECTION.step(now, Q.INSPECTION.events[w])
                    counts.update(names)
            assert Q.INSPECTION.states[again[0][0, s]] == now and dict(zip(Q.INSPECTION.counts, again[1][0, s].tolist(), strict=True)) == {c: counts[c] for c in Q.INSPECTION.counts}


@pytest.mark.parametrize("rows", [100_000, 60])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_join(spark, rows, exact):
    """A key with most rows, ties at one time, null keys and times, keys of one side alone."""
    rng = random.Random(5)
    key = lambda: "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None, "c", str(rng.randrange(30))])
    left = [(i, key(), rng.choice([None, *range(60)]), 1) for i in range(400)] + [(1000, "hot", 5, 1)] * 2
    right = [(key(), rng.choice([None, *range(0, 60, 3)]), rng.choice([None, 1, 2]), i) for i in range(150)]
    right = list({(k, t, x): (k, t, x, i) for k, t, x, i in right}.values()) + [("only right", 3, 1, 999)]
    a = spark.createDataFrame(left, "id int, k string, t int, other int").repartition(3)
    b = spark.createDataFrame(right, "key string, since int, tie int, v int")

    def want(k, t, within=None):
        old = [(s, x or 0, v) for kk, s, x, v in right if k is not None and kk == k and None not in (s, t) and (s <= t if exact else s < t)]
        return max(old)[2] if old and (within is None or t <= max(old)[0] + within) else None

    got = asof_join(a, b, {"k": "key"}, "t", "since", ["v", "tie"], tie="tie", exact=exact, rows=rows)
    assert got.columns == ["id", "k", "t", "other", "v", "tie"]
    assert sorted(((r["id"], r["v"]) for r in got.collect()), key=repr) == sorted(((i, want(k, t)) for i, k, t, _ in left), key=repr)
    near = asof_join(a, b, {"k": "key"}, "t", "since", ["v"], tie="tie", exact=exact, rows=rows, within=F.lit(4), inner=True)
    assert sorted((r["id"], r["v"]) for r in near.collect()) == sorted((i, v) for i, k, t, _ in left if (v := want(k, t, 4)) is not None)
    assert asof_join(a, b.limit(0), {"k": "key"}, "t", "since", ["v"], inner=True).count() == 0 and asof_join(a.limit(0), b, {"k": "key"}, "t", "since", ["v"]).count() == 0
    with pytest.raises(ValueError, match="twice"):
        asof_join(a, b.withColumnRenamed("v", "other"), {"k": "key"}, "t", "since", ["other"])


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("bin_rows", [20_000, 6])
def test_interval_join(spark, closed, bin_rows):
    """Intervals of no length to nearly all, a third of them in one place, empty, reversed,
    infinite and null ones, repeated rows."""
    rng = random.Random(7)

    def some(n, side):
        out = []
        for i in range(n):
            a = 5000.0 if rng.random() < 0.3 else rng.uniform(-1e4, 1e4) if rng.random() < 0.5 else float(rng.randrange(-50, 50))
            out.append((f"{side}{i % (n - 3)}", rng.choice(["x", "x", "y", None]), a, a + rng.choice([0.0, 1.0, 8.0, 9.0, rng.uniform(0, 3), rng.uniform(0, 3000), -1.0])))
        return [*out, (f"{side}inf", "x", -math.inf, math.inf), (f"{side}null", "x", None, 3.0), (f"{side}nan", "x", 0.0, math.nan), (f"{side}big", "x", 1e299, 1e301)]

    left, right = some(150, "l"), some(120, "r")
    a, b = spark.createDataFrame(left, "a string, k string, s double, e double"), spark.createDataFrame(right, "b string, m string, s2 double, e2 double")
    fine = lambda r: r[1] and None not in r and not any(map(math.isnan, r[2:])) and (r[2] <= r[3] if closed else r[2] < r[3])
    for on in ({"k": "m"}, {}):
        want = [(x[0], y[0]) for x in left for y in right if (fine(x) if on else fine((x[0], "k", *x[2:]))) and (fine(y) if on else fine((y[0], "k", *y[2:]))) and (not on or x[1] == y[1]) and (x[2] <= y[3] and y[2] <= x[3] if closed else x[2] < y[3] and y[2] < x[3])]
        joined = interval_join(a, b, on, ("s", "e"), ("s2", "e2"), closed=closed, bin_rows=bin_rows)
        assert sorted((r["a"], r["b"]) for r in joined.collect()) == sorted(want)
        plan = joined._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert interval_join(a.limit(0), b, {}, ("s", "e"), ("s2", "e2")).count() == 0
    with pytest.raises(ValueError, match="twice"):
        interval_join(a, a, {}, ("s", "e"), ("s", "e"))


def test_interval_join_of_times_and_longs(spark):
    rows = [(i, i * 60, i * 60 + w) for i in range(200) for w in (0, 59, 60, 7200)]
    times = spark.createDataFrame(rows, "i int, s long, e long").select("i", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    spans = times.select(F.col("i").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    want = sum(x[1] <= y[2] and y[1] <= x[2] for x in rows for y in rows)
    assert interval_join(times, spans, {}, ("s", "e"), ("s2", "e2")).count() == want
    far = 1 << 62
    longs = spark.createDataFrame([(far, far + 1), (-far, far), (-far - 2, -far)], "s long, e long")
    assert interval_join(longs, longs.select(F.col("s").alias("s2"), F.col("e").alias("e2")), {}, ("s", "e"), ("s2", "e2")).count() == 7


def test_interval_join_deals_by_rows(spark, monkeypatch):
    """A task joins as many rows however many there are, with full bins and without."""
    monkeypatch.setattr(intervals, "TASK_ROWS", 100)
    rows = [(i // 4, float(i % 4), i % 4 + 1.5) for i in range(1200)] + [(-1, 0.0, 1.0)] * 60
    a = spark.createDataFrame(rows, "k int, s double, e double")
    b = a.toDF("k2", "s2", "e2")
    for bin_rows in (20_000, 20):
        met = interval_join(a, b, {"k": "k2"}, ("s", "e"), ("s2", "e2"), closed=False, bin_rows=bin_rows)
        assert met.count() == 300 * (4 + 2 * 3) + 3600
        # Each row lies in two bins at most of each of two widths.
        assert met.rdd.getNumPartitions() >= 2 * len(rows) // 100


def test_requests_are_dealt_by_number(spark, tmp_path, monkeypatch):
    """Small events are not put together into one task that makes and parses all bodies."""
    monkeypatch.setattr(routes, "TASK_EVENTS", 50)
    events = spark.range(400).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "id % 7 as user_id", "'view' as event_type", "1.0D as value", "'{\"k\": 3}' as props")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    asked = routes.requests(spark, str(tmp_path))
    assert asked.count() == 400 and asked.rdd.getNumPartitions() == 9


@pytest.mark.parametrize("block_rows", [50_000, 4])
def test_totals_within(spark, block_rows):
    """Spans of no length to nearly all, in and over blocks; shared times, nulls, reversed ones."""
    rng = random.Random(3)
    points = [(rng.choice([5, rng.randrange(-40, 40), rng.randrange(-10**6, 10**6)]), rng.choice([None, *range(-3, 30)]), rng.choice([None, "a", "b", *map(str, range(20))])) for _ in range(300)] + [(None, -99, "never")]
    spans = [(i, a, a + rng.choice([-1, 0, 1, 30, rng.randrange(2 * 10**6)])) for i in range(200) for a in [rng.choice([5, rng.randrange(-50, 50), rng.randrange(-10**6, 10**6)])]]
    spans += [(200, -(10**7), 10**7), (201, None, 3), (202, 3, None), (203, 5, 5), (204, 5, 5)]
    p, s = spark.createDataFrame(points, "at long, v long, who string"), spark.createDataFrame(spans, "id int, a long, b long")
    want = []
    for i, a, b in spans:
        if None not in (a, b) and (inside := [x for x in points if x[0] is not None and a <= x[0] <= b]):
            want.append((i, len(inside), min((x[1] for x in inside if x[1] is not None), default=None), len({x[2] for x in inside} - {None})))
    times = lambda df, *names: df.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in names})
    for points_, spans_ in ((p, s), (times(p, "at"), times(s, "a", "b"))):
        got = totals_within(spans_, points_, ("a", "b"), "at", "v", "who", block_rows=block_rows)
        assert sorted((r["id"], r["n"], r["least"], r["distinct"]) for r in got.collect()) == want
    assert totals_within(s.limit(0), p, ("a", "b"), "at", "v", "who").count() == 0 and totals_within(s, p.limit(0), ("a", "b"), "at", "v", "who").count() == 0


def test_outages_do_not_list_their_events(spark, tmp_path, monkeypatch):
    """4,000 events of an hour, a third of them outages that last for most of it: pairs are
    listed for the one id that two outages share, and for no other."""
    rows = [(3 if i == 6 else i, i * 900_000, i % 50, "error" if i % 3 == 0 else "view", 40.0 + i % 7) for i in range(4000)]
    events = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double")
    events.select("event_id", F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    listed = []

    def counted(points, spans, *rest):
        listed.append(spans.count())
        return interval_join(points, spans, *rest)

    monkeypatch.setattr(joins, "interval_join", counted)
    got = {r["outage"]: (r["events"], r["first_event"], r["users"]) for r in joins.events_in_outages(spark, str(tmp_path)).collect()}
    assert listed == [2] and len(got) == 1333
    for own in ([0], [3, 6], [9], [2997], [3999]):
        inside = [(e, u) for i in own for e, t, u, _, _ in rows if rows[i][1] <= t <= rows[i][1] + round(rows[i][4] * 60_000_000)]
        assert got[own[0]] == (len(inside), min(e for e, _ in inside), len({u for _, u in inside}))


@pytest.mark.parametrize(
    ("boxes", "error"),
    [
        ("[[0, 0, 5000000000, 5000000000]]", "limit"), ("[[0, 0, 9000000000000000000, 9000000000000000000]]", "limit"), ("[[0, 0, 1e30, 1e30]]", "limit"), ("[[-9e18, 0, 9e18, 1]]", "order"),
        ("[[0, 0, 1, 1e400]]", None), ("[[0,0,1016,1016]]", None), ("[[0,0,1017,1016]]", "limit"), ("[" + "[0,0,1,1]," * 19_999 + "[0,0,1,1]]", None), ("[" + "[0,0,1,1]," * 20_000 + "[0,0,1,1]]", "count"), ("3", "boxes"), ("[[0,0,99999999999999999999999999999999999999999,1]]", "limit"),
    ],
)
def test_boxes_of_any_size(spark, boxes, error):
    rows = spark.createDataFrame([(boxes,)], "t string").select(F.try_parse_json("t").alias("v"))
    if "1e400" in boxes:  # no number that JSON readers agree on
        return
    assert B.box_list(rows, "v").first()["error"] == error


@pytest.mark.parametrize(("tiers", "n"), [("1e30", -1), ("-1e30", -1), ("6.9", 6), ("7", -1), ("0.5", -1), ("-2", -1), ("5000000000", -1), ('"99999999999999999999999"', -1), ("true", 1), ("false", -1), ("null", None)])
def test_tiers_of_any_size(spark, tiers, n):
    assert spark.createDataFrame([(tiers,)], "t string").select(B.tier_count(F.try_parse_json("t")).alias("n")).first()["n"] == n


def test_route_takes_the_first_error(spark):
    """One request for each rule, which breaks later rules too, and ones that break none."""
    info = spark.createDataFrame([("a", True, 3), ("one", False, 1), ("new", True, 0), ("big", True, 0)], "file string, multi boolean, pages int")
    images = spark.createDataFrame([("a", 1, 100, 200, "ia1"), ("a", 2, 100, 200, "ia2"), ("one", 1, 50, 50, "i1"), ("new", 9, 10, 10, "n9"), ("big", 1, 900, 90_000, "b1")], "file string, page int, width int, height int, image string")
    layouts = spark.createDataFrame([("a", [0.5], 1.5, None), ("one", [], 1.0, 2.0)], "file string, tiers array<double>, ratio double, read_ratio double")
    models = {"hangul": True, "hanmun": False}
    read, boxes, edge, area, compare = "/api/read", "/api/boxes", "/api/edge", "/api/area-read", "/api/compare"
    cases = [
        ("GET", read, "{}", 404, "method"), ("OPTIONS", "/x", "{", 204, None), (None, None, None, 404, "method"), ("POST", read, "[]", 400, "body"), ("POST", read, '{"a": "' + "x" * 5_000_000 + '"}', 400, "length"),
        ("POST", read, '{"page": 0}', 400, "file"), ("POST", read, '{"file": "a", "page": 0}', 400, "page"), ("POST", "/x", '{"file": "a"}', 404, "path"), ("POST", read, '{"file": "zz", "threshold": 2, "tiers": 9}', 400, "threshold"),
        ("POST", read, '{"file": "new", "tiers": 9}', 409, "layout"), ("POST", read, '{"file": "a", "tiers": 9, "model": "x"}', 400, "tiers"), ("POST", read, '{"file": "a", "model": "x", "page": 9}', 400, "model"),
        ("POST", read, '{"file": "a", "model": "hanmun", "page": 9}', 400, "model_file"), ("POST", read, '{"file": "a", "page": 9}', 400, "page"), ("POST", read, '{"file": "a", "page": 3}', 400, "scan"), ("POST", read, '{"file": "a", "page": 2, "tiers": 3}', 200, None),
        ("POST", compare, '{"file": "new"}', 400, "text"), ("POST", compare, '{"file": "new", "text": ""}', 409, "layout"), ("POST", compare, '{"file": "one", "text": "t"}', 200, None),
        ("POST", boxes, '{"file": "zz", "boxes": [[1, 2, 3]], "model": "x"}', 400, "shape"), ("POST", boxes, '{"file": "zz", "boxes": []}', 400, "missing"), ("POST", boxes, '{"file": "a", "boxes": [[0, 0, 1, 1], [0, 0, 101, 5]], "model": "x"}', 400, "outside"),
        ("POST", boxes, '{"file": "a", "boxes": [[0, 0, 100, 200]], "model": "x"}', 400, "model"), ("POST", boxes, '{"file": "a"}', 200, None),
        ("POST", area, '{"file": "zz", "model": "x", "ratio": 0}', 400, "model"), ("POST", area, '{"file": "zz", "ratio": 0}', 400, "ratio"), ("POST", area, '{"file": "one", "page": 2}', 400, "page"), ("POST", area, '{"file": "a", "width": 99}', 400, "size"), ("POST", area, '{"file": "a", "height": "200"}', 400, "size"),
        ("POST", area, '{"file": "a", "width": 100.0, "height": null, "ratio": "2"}', 200, None), ("POST", edge, '{"file": "zz", "x0": 1}', 400, "coordinate"), ("POST", edge, '{"file": "zz", "x0": 5, "x1": 5}', 400, "order"), ("POST", edge, '{"file": "zz", "x0": 0, "x1": 23}', 400, "zoom"),
        ("POST", edge, '{"file": "zz", "x0": 0, "x1": 24}', 400, "missing"), ("POST", edge, '{"file": "a", "x0": 0, "x1": 101}', 400, "outside"), ("POST", edge, '{"file": "big", "x0": 0, "x1": 96}', 400, "height"), ("POST", edge, '{"file": "a", "x0": 0, "x1": 100}', 200, None),
        ("POST", area, '{"file": "one"}', 500, "server"),
    ]
    asked = spark.createDataFrame([(i, m, p, b, 1000 * i) for i, (m, p, b, _, _) in enumerate(cases)], "req long, method string, path string, body string, at long").repartition(3)
    none = spark.createDataFrame([], "op string, image string, params string, expires long, answer string")

    def recognise(rows):
        return rows.withColumns({"answer": F.when(~((F.col("op") == "area-read") & (F.col("file") == "one")), F.concat_ws(" ", "op", "file", F.to_json("layout"))), "reason": F.when(F.col("op") == "compare", "blank")})

    run = lambda results: {r["req"]: r for r in route.answered(asked, info, images, layouts, results, models, recognise, seconds=1).collect()}
    got = run(none)
    assert len(got) == len(cases)
    for i, (_, path, body, code, error) in enumerate(cases):
        r = got[i]
        assert (r["code"], r["error"]) == (code, error), (path, body, r)
        assert (r["answer"] is not None) == (code == 200) and not r["reused"]
        assert (r["expires"] is not None) == (code == 200 and path in (read, area)) and (r["bad_pos"] is None) == (error not in ("shape", "outside") or path != boxes)
    assert got[15]["answer"].startswith("read a") and "0.333" in got[15]["answer"]
    stored = spark.createDataFrame([(r["op"], r["image"], r["params"], r["expires"], "kept") for r in got.values() if r["expires"]], none.schema)
    again = run(stored)
    assert {i for i, r in again.items() if r["reused"]} == {i for i, r in got.items() if r["expires"]} and all(r["answer"] == "kept" and r["expires"] is None for r in again.values() if r["reused"])
    late = route.answered(asked.withColumn("at", F.col("at") + 1_000_000), info, images, layouts, stored, models, recognise)
    assert late.filter("reused").count() == 0


def test_short_items_without_a_broadcast(spark):
    """Items of no, one and more characters and words, at either end, within words, repeated."""
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choices("abé", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", None, "one two three four five six seven"]
    expected = ["", "a", "ab", "é", "ab é", "aab a", "one two three", "e two three four f", "one two three four five six", "ive six seven", "zz", None, "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    items = spark.createDataFrame(list(enumerate(expected)), "i int, text string")
    want = sorted((d, i) for d, t in enumerate(texts) for i, e in enumerate(expected) if t is not None and e is not None and e in t)
    for most in (1000, 0):
        assert sorted(tuple(r) for r in Q.containing(docs, "d", items, "i", most).collect()) == want


def test_equal_bodies_have_one_canonical_text(spark):
    from scanloom.functions import scalar as S

    bodies = ['{"b": 1, "a": {"d": [1, {"y": null, "x": "é"}], "c": 2}}', '{"a": {"c": 2, "d": [1, {"x": "é", "y": null}]}, "b": 1}', '{"a":{"c":2,"d":[{"x":"é","y":null},1]},"b":1}']
    got = [r["c"] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(S.canonical(F.try_parse_json("b")).alias("c")).collect()]
    assert got[0] == got[1] == '{"a":{"c":2,"d":[1,{"x":"é","y":null}]},"b":1}' != got[2]


def test_lines_that_edge_trimming_left(spark):
    from scanloom.operators import recognise as R

    lines = "array<struct<ch:array<string>,conf:array<double>,box:array<int>>>"
    rows = [([(["a", "."], [0.1, 0.2], [1, 2]), None, (["b"], [0.3], [3])], left) for left in (None, [2, 0], [1], [0, 9], [])]
    df = spark.createDataFrame(rows, f"lines {lines}, left array<int>")
    got = [["".join(x["ch"]) for x in r[0]] for r in df.select(R.kept_lines(F.col("lines"), ["."], F.col("left"))).collect()]
    assert got == [["a", "b"], ["b", "a"], [], ["a"], []]
    layouts = spark.createDataFrame([(([0.5], 1.0), ([], [0.25], 3.0, 2.0, [9.0])), (([0.5], 1.0), ([1], [0.25], 3.0, 2.0, [9.0])), (([0.5], 1.0), None)], "l struct<tiers:array<double>,ratio:double>, g struct<blank:array<int>,tiers:array<double>,pitch:double,xpitch:double,tier_ratios:array<double>>")
    seen = [tuple(r["s"]) for r in layouts.select(R.seen_layout(F.col("l"), F.col("g")).alias("s")).collect()]
    assert seen == [([0.5], 1.0, None, None), ([0.25], 1.5, [1], [9.0]), ([0.5], 1.0, None, None)]


def test_ttl_hits_are_cut_at_gaps(spark):
    """A user with most requests over all ranges, long and short gaps, times out of order, null
    times and a null user."""
    rng, log, now = random.Random(14), [], 0
    for i in range(1500):
        now += rng.choice([1, 5, 20, 59, 60, 61, 300]) if rng.random() < 0.3 else 1
        log.append((rng.choice(["hot"] * 8 + ["a", "b", None]), i, None if rng.random() < 0.02 else now - rng.choice([0, 0, 0, 30])))
    want = {}
    for user in {u for u, _, _ in log}:
        expires, hits, own = None, 0, [t for u, _, t in log if u == user]
        for t in own:
            if t is not None and expires is not None and t < expires:
                hits += 1
            else:
                expires = None if t is None else t + 60
        want[user] = (len(own), hits)
    df = spark.createDataFrame(rng.sample(log, len(log)), "u string, seq long, t int").repartition(3)
    assert {r["u"]: (r["requests"], r["hits"]) for r in Q.ttl_hits(df, "u", "seq", "t", 60).collect()} == want
    assert Q.ttl_hits(df.limit(0), "u", "seq", "t", 60).count() == 0
