"""The layout store, streams with restarts and timers, inspections and aggregates, against
plain Python models."""

import os
import random
import subprocess
import sys
import textwrap
import threading
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from conftest import REPO
from scanloom.operators import aggregates as A
from scanloom.operators import inspect as I  # noqa: E741
from scanloom.operators import tables as T
from scanloom.plans import inspections
from scanloom.sources import store
from scanloom.streaming import pending, timed, windows


def layouts(spark, pairs):
    return spark.createDataFrame(pairs, "file string, ratio double")


def stored(spark, path, rules=5, version=None):
    return {r["file"]: r["ratio"] for r in store.load(spark, path, rules, version).collect()}


def test_store_keeps_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    assert stored(spark, path) == {} and store.versions(spark, path) == []
    assert store.save(layouts(spark, [(f"f{i}", float(i)) for i in range(50)]), path, 5, buckets=7) == 1
    reader = store.load(spark, path, 5)
    assert store.save(layouts(spark, [("f1", -1.0), ("new", 9.0), ("new", 3.0)]), path, 5) == 2
    want = {f"f{i}": float(i) for i in range(50)}
    assert stored(spark, path) == want | {"f1": -1.0, "new": 9.0}
    assert {r["file"]: r["ratio"] for r in reader.collect()} == want == stored(spark, path, version=1)
    a, b = (store.manifest(spark, path, v)["buckets"] for v in (1, 2))
    assert 1 <= sum(a[k] != b[k] for k in a) <= 2 and len(b) == 7  # other buckets are as they were
    assert store.save(layouts(spark, []), path, 5) == 2
    assert store.save(layouts(spark, [("f2", 0.0)]), path, 6) == 3
    assert "f2" not in stored(spark, path) and stored(spark, path, 6) == {"f2": 0.0}
    with pytest.raises(ValueError, match="without a file"):
        store.save(layouts(spark, [(None, 0.0)]), path, 5)
    now = stored(spark, path)
    assert store.vacuum(spark, path, 1) and store.versions(spark, path) == [3] and stored(spark, path) == now


def test_store_with_two_writers_and_a_failed_write(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store.save(layouts(spark, [("a", 1.0)]), path, 5)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", broken)
        with pytest.raises(OSError, match="lost"):
            store.save(layouts(spark, [("a", 2.0)]), path, 5)
    assert stored(spark, path) == {"a": 1.0} and store.versions(spark, path) == [1]

    # The other writer publishes after this one has read the manifest and written its data.
    publish, rival = store._publish, [("a", 7.0), ("rival", 7.0)]

    def late(s, p, found):
        if rival:
            rows = rival.copy()
            rival.clear()
            store.save(layouts(s, rows), p, 5)
        return publish(s, p, found)

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", late)
        assert store.save(layouts(spark, [("a", 3.0), ("own", 3.0)]), path, 5) == 3
    assert stored(spark, path) == {"a": 3.0, "own": 3.0, "rival": 7.0} and store.versions(spark, path) == [1, 2, 3]
    threads = [threading.Thread(target=store.save, args=(layouts(spark, [(f"t{i}", float(i))]), path, 5)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {f"t{i}" for i in range(3)} < set(stored(spark, path)) and store.versions(spark, path)[-1] == 6


def test_pending_requests_survive_a_restart(spark, tmp_path, monkeypatch):
    """The second batch fails after its answers are written, and runs again."""
    put = lambda n, files: spark.createDataFrame([(f, 100 * n + i) for i, f in enumerate(files)], "file string, id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("file string, id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    known = lambda: spark.createDataFrame([("a", 1.5)], "file string, ratio double")
    run = lambda: pending.serve(stream(), known, f"{tmp_path}/answers", f"{tmp_path}/work", f"{tmp_path}/check").awaitTermination()
    put(0, ["a", "b", "b", None])
    run()
    put(1, ["c", "b", "a", "c"])
    with monkeypatch.context() as m:
        m.setattr(pending, "to_inspect", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division"):
            run()
    run()
    put(2, ["d", "c"])
    run()
    answers = [(r["id"], r["code"], r["ratio"]) for r in spark.read.parquet(f"{tmp_path}/answers").collect()]
    assert sorted(answers) == [(0, 200, 1.5), (1, 409, None), (2, 409, None), (3, 409, None), (100, 409, None), (101, 409, None), (102, 200, 1.5), (103, 409, None), (200, 409, None), (201, 409, None)]
    work = spark.read.parquet(f"{tmp_path}/work").select("file", "batch").collect()
    assert sorted(tuple(r) for r in work) == [("b", 0), ("c", 1), ("d", 2)]


def test_hanging_inspections_expire(spark, tmp_path):
    """Gaps within a batch, between batches and at the end; what ends in time stays."""
    log = [[("a", 1, 0, "request"), ("b", 2, 10, "request"), ("a", 3, 200, "request"), ("c", 4, 201, "request"), ("c", 5, 202, "done")], [("b", 6, 500, "request"), ("a", 7, 505, "failed"), ("d", 8, 506, "request")], [("a", 9, 590, "request"), ("e", 10, 900, "request")]]
    for i, rows in enumerate(log):
        spark.createDataFrame([(i, *r) for r in rows], "n int, file string, seq long, t long, event string").select("file", "seq", F.timestamp_seconds(F.col("t") + 1000).alias("ts"), "event").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("file string, seq long, ts timestamp, event string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timed.PROVIDER)
    try:
        sink = lambda rows, n: rows.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        timed.inspections(stream, 100).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    last = spark.read.parquet(f"{tmp_path}/out").groupBy("file").agg(F.max_by(F.struct("state", "running", "failed", "done", "starts", "expired"), F.struct("n", "running", "expired")).alias("x")).collect()
    got = {r["file"]: tuple(r["x"]) for r in last}
    assert got == {"a": ("absent", 3, 0, 0, 3, 3), "b": ("absent", 2, 0, 0, 2, 2), "c": ("done", 1, 0, 0, 1, 0), "d": ("absent", 1, 0, 0, 1, 1), "e": ("running", 1, 0, 0, 1, 0)}


def test_sessions_leave_late_rows_out(spark, tmp_path):
    # A batch's own rows are held against the watermark that the batch before began with.
    rows = [[(1, 0, 1.0), (1, 50, 1.0), (2, 400, 1.0)], [(2, 450, 1.0)], [(1, 5, 9.0), (1, 2000, 1.0)], [(2, 5000, 1.0)]]
    for part in rows:
        spark.createDataFrame(part, "user long, t long, value double").select("user", F.timestamp_seconds("t").alias("ts"), "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = windows.append_to(windows.sessions(stream, "user", "100 seconds", "100 seconds"), f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination()
    got = sorted((r["user"], r["start"].timestamp() % 86400, r["n"], r["total"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 0, 2, 2.0), (1, 2000, 1, 1.0), (2, 400, 2, 2.0)] and windows.left_out(query) == 1


def test_inspected(spark):
    """Files of no and of unknown length, each step's failure in and out of its sample, a
    client's message after other failures, repeated and missing pages."""
    files = spark.createDataFrame([("one", False, 3), ("unknown", True, 0), ("short", True, 3), ("short", True, 3), ("long", True, 100), ("stopped", True, 4), ("none", True, 2)], "file string, multi boolean, pages int")
    # 100 pages: the first sample is 1, 9, ... 89, the second 1, 13, ... 85.
    m = [("short", 1, "i1", 0.2, 1.0, 4, None, None), ("short", 2, "i2", 0.4, 2.0, 5, "columns", None), ("short", 3, "i3", 0.6, 3.0, 6, "tier", None), ("short", 1, "i1", 0.1, 1.0, 4, None, None)]
    m += [("stopped", 1, "x", 0.1, 1.0, 1, "fetch", None), ("stopped", 3, "x", 0.1, 1.0, 1, None, "second"), ("stopped", 2, "x", 0.1, 1.0, 1, None, "first"), ("short", 9, "i", 9.0, 9.0, 9, None, "not sampled")]
    m += [("long", p, f"p{p}", p / 100, float(p), p, {9: "tier", 13: "gap", 25: "gap", 49: "columns", 1: "tier"}.get(p), None) for p in range(1, 101)]
    measures = spark.createDataFrame(m, "file string, page int, image string, gap double, tier double, columns int, failed string, client string")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "-")
    numbers = I.inspected(files, measures, lambda g, t: F.transform(F.concat(g, t), lambda x: F.coalesce(x, F.lit(-1.0))), lambda p, t: F.when(F.size(p) > 0, F.aggregate(p, F.lit(0.0), lambda a, x: a + x)), text, lambda p, r, t, f: F.array_max(p).cast("double"))
    got = {r["file"]: r.asDict() for r in numbers.collect()}
    plain = {"state": "done", "message": None, "tiers": [], "ratio": None, "frame": None, "read_ratio": None, "measured": 0, "failed_pages": 0}
    assert got["one"] == {"file": "one", **plain} and got["unknown"] == {"file": "unknown", **plain}
    assert got["stopped"] == {"file": "stopped", **plain, "state": "failed", "message": "first", "tiers": None, "measured": 2, "failed_pages": 2}
    assert got["none"] == {"file": "none", **plain, "tiers": [-1.0] * 4, "frame": "", "failed_pages": 2}
    assert got["short"] == {"file": "short", **plain, "tiers": [0.2, -1.0, -1.0, 1.0, -1.0, -1.0], "ratio": 3.0, "frame": "4", "read_ratio": 2.0, "measured": 1, "failed_pages": 2}
    long = got["long"]
    first, second = list(range(1, 101))[::8][:12], list(range(1, 101))[::12][:8]
    broken = {1, 25, 49}  # 9 breaks at tiers and 13 at gaps, which are not looked for there
    assert long["tiers"] == [-1.0 if p in broken else p / 100 for p in first] + [-1.0 if p in broken else float(p) for p in second]
    assert long["ratio"] == sum(p for p in second if p not in {1, 25}) and long["measured"] == len({*first, *second} - broken) and long["failed_pages"] == 3
    assert len(got) == 6


def test_levels_and_distinct_counts(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, None]), rng.randrange(5) or None, "hot" if rng.random() < 0.8 else "cold") for _ in range(500)]
    df = spark.createDataFrame(rows, "x string, y int, v int, g string")
    got = {(r["x"], r["y"], r["level"]): (r["n"], r["t"]) for r in A.levels(df, ["x", "y"], [["x", "y"], ["y"], []], n=F.count("*"), t=F.sum("v")).collect()}
    want = defaultdict(lambda: [0, 0])
    for x, y, v, _ in rows:
        for k in ((x, y, 0), (None, y, 2), (None, None, 3)):
            want[k][0] += 1
            want[k][1] += v or 0
    assert got == {k: tuple(v) for k, v in want.items()}
    assert A.levels(df.limit(0), ["x"], [["x"], []], n=F.count("*")).count() == 0
    with pytest.raises(ValueError, match="no keys"):
        A.levels(df, ["x"], [["z"]], n=F.count("*"))
    plan = A.levels(df, ["x", "y"], [["x"], []], n=F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    counts = {r["g"]: (r["v"], r["x"]) for r in A.distinct_counts(df, ["g"], ["v", "x"]).collect()}
    assert counts == {g: (len({r[2] for r in rows if r[3] == g} - {None}), len({r[0] for r in rows if r[3] == g} - {None})) for g in ("hot", "cold")}
    many = spark.range(30_000).select(F.lit("k").alias("k"), (F.col("id") % 7).alias("d"), "id")
    estimate = A.merged_estimates(A.sketches(many, ["k", "d"], "id"), ["k"]).first()["estimate"]
    assert abs(estimate - 30_000) < 4 * A.SKETCH_ERROR * 30_000


def test_lines_of_pages(spark):
    pages = [("a", 2, "x,y"), ("b", 1, ""), ("a", 1, "p"), (None, 1, "q,r"), ("a", 3, None), ("b", 2, "z")]
    df = spark.createDataFrame(pages, "page string, col int, text string").repartition(3)
    read = lambda row: [(t,) for t in (row["text"] or "").split(",") if t]
    function = T.lines_of(read, [StructField("text", StringType())], "page", ["col"])
    got = [tuple(r) for r in T.read_pages(spark, df, "some_lines", function).collect()]
    assert sorted(got, key=repr) == sorted([("a", 0, "p"), ("a", 1, "x"), ("a", 2, "y"), ("b", 0, "z"), (None, 0, "q"), (None, 1, "r")], key=repr)
    spark.createDataFrame([("b",), ("c",)], "want string").createOrReplaceTempView("wanted")
    joined = spark.sql("SELECT w.want, l.line, l.text FROM wanted w JOIN some_lines(TABLE(_some_lines_rows)) l ON l.page = w.want")
    assert [tuple(r) for r in joined.collect()] == [("b", 0, "z")]
    with pytest.raises(Exception, match="no column"):
        T.read_pages(spark, df.drop("col"), "some_lines", function).collect()


def test_import_after_the_session(tmp_path):
    """Workers find the package though the session knew nothing of it when it began."""
    code = f"""
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        spark.range(10).count()
        import sys
        sys.path.append({REPO!r})
        import __spark_entry__ as entry
        print("ROWS", entry.queries()["inspection_log"](spark, "/root/testdata/sf0.001").count())
    """
    env = {"PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(tmp_path), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    env |= {k: v for k, v in os.environ.items() if k in ("JAVA_HOME", "PATH", "LD_LIBRARY_PATH")}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS" in done.stdout, done.stderr[-3000:]
    assert int(done.stdout.split("ROWS")[1]) > 0


def test_copies_of_a_month_are_streamed_by_time(spark, tmp_path):
    """Later ids at the same times again: the watermark leaves none of them out, and each part
    is one micro-batch however many files it has."""
    kinds = ["view", "error", "purchase", "click", "view"]
    one = [(i, i * 5_000_000_000 + 1, i % 7, kinds[i * i % 5], 1.0, "{}") for i in range(400)]
    rows = [*one, *((i + 400, t, u + 7, *more) for i, t, u, *more in one)]
    events = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string")
    events.select("event_id", F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["file"]: tuple(r)[1:] for r in inspections.inspection_stream(spark, str(tmp_path)).collect()}
    assert len(got) == 14

    def folded(file):
        state, heard, counts, own = "absent", None, [0] * 5, [x for x in rows if x[2] == file]
        for i, t, _, kind, _, _ in own:
            event = {"error": "failed", "purchase": "done" if i % 40 == 0 else "other"}.get(kind, "request")
            if heard is not None and t // 1000 - heard > 43_200_000 and state == "running":
                state, counts[4] = "absent", counts[4] + 1
            state, names = timed.TIMED.step(state, event)
            for name in names:
                counts[timed.COUNTS.index(name)] += 1
            heard = t // 1000
        if state == "running" and heard + 43_200_000 < rows[-1][1] // 1000:
            state, counts[4] = "absent", counts[4] + 1
        return (state, *counts)

    assert got == {file: folded(file) for file in range(14)}
