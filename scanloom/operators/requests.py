"""Samples, limits, lookups and cache states as DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.folds import Machine, fold
from scanloom.sources.shared import written

PIXELS_EACH = 1_048_576
PIXELS_ALL = 16_777_216
MARGIN = 8
CACHE_FILES = 1500
CACHE_SLACK = 100
IMAGE_SLOTS = 6
#: Characters by which short items are met in texts, where there are many of them.
GRAM = 8


def even_sample(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """At most k rows of each group at even steps from the first, with place p of n.

    Places are found on group and order alone: laid out once in ranges of them, where a
    group may fill many, and counted from the ranges' counts.  Only picked rows meet their
    other columns.
    """
    by = [group, *order]
    alone = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = written(alone.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy(group, "_range").orderBy(*order)
    over = Window.partitionBy("_group")
    counts = ranged.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_of")).agg(F.sum("_rows").alias("_m"))
    counts = counts.withColumn("_before", F.sum("_m").over(over.orderBy("_of")) - F.col("_m")).withColumn("n", F.sum("_m").over(over))
    placed = ranged.withColumn("_first", F.sum("_rows").over(within) - F.col("_rows")).join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    placed = placed.withColumn("_first", F.col("_first") + F.col("_before"))

    step = F.greatest(F.lit(1), F.floor(F.col("n") / max(k, 1)))
    everything = F.lit(k <= 0) | (F.col("n") <= k)
    next_pick = F.ceil(F.col("_first") / step)
    picked = placed.filter(everything | ((next_pick * step < F.col("_first") + F.col("_rows")) & (next_pick < k)))
    picked = picked.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), "_first", "n")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)))
    rows = df.drop("p", "n").join(picked, same)
    rows = rows.withColumn("p", F.col("_first") + F.row_number().over(Window.partitionBy(*by).orderBy("_first")))
    keep = everything | (((F.col("p") - 1) % step == 0) & (F.floor((F.col("p") - 1) / step) < k))
    return rows.filter(keep).select(*(c for c in df.columns if c not in ("p", "n")), "p", "n")


def even_pages(n: Column, k: int) -> Column:
    """The pages 1..n that even_sample would take, as an array."""
    step = F.greatest(F.lit(1), F.floor(n / max(k, 1)).cast("int"))
    every = F.sequence(F.lit(1), n)
    return F.when((n <= k) | F.lit(k <= 0), every).otherwise(F.slice(F.sequence(F.lit(1), n, step), 1, max(k, 1)))


def page_exists(multi: Column, pages: Column, page: Column) -> Column:
    """A single image has page 1 alone; an unknown count (0) has no upper bound."""
    return F.when(page < 1, False).when(~multi & (page != 1), False).when(multi & (pages != 0) & (page > pages), False).otherwise(True)


def box_limits(boxes: DataFrame, request: str, pos: str) -> DataFrame:
    """Per request the first box (x0, y0, x1, y1 at pos) that breaks a rule, and which."""
    side = lambda low, high: F.col(high).cast("double") - F.col(low) + MARGIN  # noqa: E731  no product is too large
    area = side("x0", "x1") * side("y0", "y1")
    running = Window.partitionBy(request).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    reason = (
        F.when((F.col("x0") < 0) | (F.col("x0") >= F.col("x1")) | (F.col("y0") < 0) | (F.col("y0") >= F.col("y1")), "order")
        .when(F.col("area") > PIXELS_EACH, "box").when(F.sum("area").over(running) > PIXELS_ALL, "total")
    )
    judged = boxes.withColumn("area", area).withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct(pos, "reason")))
    return judged.groupBy(request).agg(F.count("*").alias("n_boxes"), first.alias("x")).select(request, "n_boxes", F.col(f"x.{pos}").cast("long").alias("bad_pos"), F.coalesce("x.reason", F.lit("ok")).alias("reason"))


def evicted_files(files: DataFrame, most: int = CACHE_FILES, slack: int = CACHE_SLACK) -> DataFrame:
    """Files (key, mtime) that go when there are more than ``most``: all but the newest
    most - slack.  Only the cut-off is found by a top-k; there is no global window."""
    n = files.count()
    if n <= most:
        return files.limit(0)
    keep = files.orderBy(F.desc("mtime"), F.desc("key")).limit(most - slack)  # the cache's own limit
    return files.join(F.broadcast(keep.select("key")), "key", "left_anti")


def last_access(log: DataFrame, key: str, when: str) -> DataFrame:
    return log.groupBy(key).agg(F.max(when).alias("mtime"))


def lru_keys(log: DataFrame, key: str, seq: str, slots: int = IMAGE_SLOTS) -> DataFrame:
    """What an LRU of ``slots`` keys holds at the end of an access log."""
    return log.groupBy(key).agg(F.max(seq).alias("last")).orderBy(F.desc("last")).limit(slots)


def ttl_hits(log: DataFrame, key: str, seq: str, seconds: str, ttl: int) -> DataFrame:
    """Requests and hits per key when a miss stores for ttl seconds from its own time and a
    hit doesn't lengthen that.

    A request that comes ttl or more after all before it is a miss whatever was stored, and
    so is one without a time: there a key's log is cut, and the pieces are folded apart,
    each by a task that reads it as a stream.  A key whose requests never leave such a gap is
    one piece.  Where the cuts are is found in ranges of (key, seq), as are places by even_sample().
    """
    kind = dict(log.dtypes)[key]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, requests, hits, expires, type_ = None, 0, 0, None, None
        for batch in batches:
            type_, done = batch.schema.field(0).type, []
            for *at, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if requests and at != last:
                    done.append((last[0], requests, hits))
                    requests, hits, expires = 0, 0, None
                last, requests = at, requests + 1
                if t is not None and expires is not None and t < expires:
                    hits += 1
                else:
                    expires = None if t is None else t + ttl
            yield told(done, type_)
        if requests:
            yield told([(last[0], requests, hits)], type_)

    def told(done: list, type_) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) if done else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], type_), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], [key, "requests", "hits"])

    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = log.select(F.col(key).alias("_key"), F.col(seq).alias("_seq"), F.col(seconds).cast("double").alias("_t"))
    ranged = written(rows.repartitionByRange(parts, "_key", "_seq", "_t").withColumn("_part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_key", "_part").orderBy("_seq", "_t")
    before = Window.partitionBy("_of").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_in"))
    # Of a range only the first key goes on from earlier ones: a row a range is broadcast.
    ends = ranged.groupBy(F.col("_key").alias("_of"), F.col("_part").alias("_in")).agg(F.max("_t").alias("_end"))
    carry = ends.withColumn("_carry", F.max("_end").over(before)).filter("_carry is not null").drop("_end")
    latest = F.greatest(F.max("_t").over(within.rowsBetween(Window.unboundedPreceding, -1)), "_carry")
    cut = F.col("_t").isNull() | latest.isNull() | (F.col("_t") >= latest + ttl)
    place = F.struct(F.col("_part").alias("p"), F.row_number().over(within).alias("i"))
    marked = written(ranged.join(F.broadcast(carry), same, "left").withColumn("_cut", F.when(cut, place)).select("_key", "_seq", "_t", "_part", "_cut"), "cuts")
    ends = marked.groupBy(F.col("_key").alias("_of"), F.col("_part").alias("_in")).agg(F.max("_cut").alias("_end"))
    carry = ends.withColumn("_carry", F.max("_end").over(before)).filter("_carry is not null").drop("_end")
    piece = F.coalesce(F.last("_cut", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)), "_carry")
    pieces = marked.join(F.broadcast(carry), same, "left").select("_key", piece.alias("_piece"), "_seq", "_t")
    pieces = pieces.select("_key", F.col("_piece.p").alias("_p"), F.col("_piece.i").alias("_i"), "_seq", "_t")
    ordered = pieces.repartition("_key", "_p", "_i").sortWithinPartitions("_key", "_p", "_i", "_seq", "_t")
    folded = ordered.select("_key", "_p", "_i", "_t").mapInArrow(fold, f"`{key}` {kind}, requests long, hits long")
    return folded.groupBy(key).agg(F.sum("requests").alias("requests"), F.sum("hits").alias("hits"))


def inspection_log(log: DataFrame, file: str, seq: str, event: str, **ranges: int) -> DataFrame:
    """Per file: requests answered running, failed and done, how often an inspection began,
    and the state at the end, from its events (request, failed, done) in order.

    The first request starts an inspection; a failure is told to one request, which clears
    it, so that the next one starts again; done stays.  Other events, and failed or done
    with no inspection running, change nothing.
    """
    return fold(log, file, [seq], event, INSPECTION, "absent", **ranges)


def inspection_step(state: str, event: str) -> tuple[str, tuple[str, int] | None]:
    """(next state, (answer to a request, whether it began an inspection))."""
    if event == "request":
        if state == "failed":
            return "absent", ("failed", 0)
        return ("running", ("running", 1)) if state == "absent" else (state, (state, 0))
    return (event, None) if state == "running" and event in ("failed", "done") else (state, None)


def _counted(state: str, event: str) -> tuple[str, tuple[str, ...]]:
    after, answer = inspection_step(state, event)
    return after, () if answer is None else (answer[0], "starts") if answer[1] else (answer[0],)


INSPECTION = Machine(("absent", "running", "failed", "done"), ("request", "failed", "done"), ("running", "failed", "done", "starts"), _counted)


def with_metadata(asked: DataFrame, info: DataFrame, file: str, page: str) -> DataFrame:
    """asked with ``code`` (200, or 400) and ``reason`` (ok, missing, page): files joined to
    their metadata (file, multi, pages, template), hashed or broadcast as Spark sees fit."""
    known = info.select(F.col("file").alias("_file"), "multi", "pages", "template", F.lit(True).alias("_known"))
    rows = asked.join(known, F.col(file) == F.col("_file"), "left")
    reason = F.when(F.col("_known").isNull(), "missing").when(~page_exists(F.col("multi"), F.col("pages"), F.col(page)), "page").otherwise("ok")
    return rows.withColumn("reason", reason).withColumn("code", F.when(reason == "ok", 200).otherwise(400)).drop("_file", "_known", "multi", "pages")


def with_layout(asked: DataFrame, layouts: DataFrame, file: str) -> DataFrame:
    """asked with its file's layout and ``code``: 409 where the file has none yet."""
    known = layouts.select(F.col("file").alias("_file"), *(c for c in layouts.columns if c != "file"), F.lit(True).alias("_known"))
    rows = asked.join(known, F.col(file) == F.col("_file"), "left")
    return rows.withColumn("code", F.when(F.col("_known"), 200).otherwise(409)).drop("_file", "_known")


def to_inspect(asked: DataFrame, layouts: DataFrame, file: str) -> DataFrame:
    """The files asked for that have no layout: new inspection work, each once."""
    return asked.select(F.col(file).alias("file")).filter("file is not null").join(layouts.select("file"), "file", "left_anti").distinct()


def with_results(asked: DataFrame, results: DataFrame, key: list[str], at: str) -> DataFrame:
    """asked with ``reused``: whether a stored result (key, expires) of all parts of its key
    has not expired at the time of the request (the expiry itself counts as expired)."""
    live = results.groupBy(*key).agg(F.max("expires").alias("_expires"))
    return asked.join(live, key, "left").withColumn("reused", F.coalesce(F.col("_expires") > F.col(at), F.lit(False))).drop("_expires")


def inspected_pages(n: Column, failing: Column) -> Column:
    """struct of arrays for a file of n pages: ``pages`` sampled for either measurement (all
    of the first sample, then the new ones of the second), the pages measured in ``first``
    and ``second``, and those of the second with an image (``failing`` pages have none)."""
    first, second = even_pages(n, 12), even_pages(n, 8)
    good = lambda pages: F.filter(pages, lambda p: ~F.array_contains(failing, p))
    every = F.array_union(first, second)
    with_image = F.filter(second, lambda p: F.array_contains(good(every), p))
    return F.struct(every.alias("pages"), good(first).alias("first"), good(second).alias("second"), with_image.alias("with_image"))


def with_default(df: DataFrame, column: str, registry: DataFrame, key: str, default: str) -> DataFrame:
    """Look a name up in a registry, empty meaning default.  Spark broadcasts the registry if
    it is small."""
    name = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))
    return df.withColumn(column, name).join(registry, F.col(column) == registry[key], "left")


def _grams(text: Column, n: int) -> Column:
    """The different runs of n characters of a text; the empty one for 0."""
    places = F.sequence(F.lit(1), F.length(text) - n + 1) if n else F.array(F.lit(1))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))


def containing(docs: DataFrame, doc: str, items: DataFrame, item: str, most_short: int = 1000) -> DataFrame:
    """Pairs (doc, item) whose ``text`` of the document holds that of the item.

    An item of six words or more is met by its second to fifth words, which are whole words
    of any text that holds it; pairs of ids alone are joined, then texts are fetched for
    them.  Shorter items are held against every text by a broadcast where they are
    ``most_short`` at most, and else are met by their first ``GRAM`` characters (all, if
    fewer), which texts then give for every place.
    """
    words = lambda c: F.split(F.regexp_replace(c, r"^\s+", ""), r"\s+")
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - 3), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, 4), " "))))
    keys = docs.withColumn("_w", words(F.col("text"))).filter(F.size("_w") > 3).select(F.col(doc).alias("_doc"), F.explode(runs).alias("_key"))
    asked = items.select(F.col(item).alias("_item"), F.col("text").alias("_expected")).withColumn("_w", words(F.col("_expected")))
    texts = docs.select(F.col(doc).alias("_doc"), F.col("text").alias("_text"))
    few = asked.filter(F.size("_w") < 6).select("_item", "_expected")
    long = asked.filter(F.size("_w") >= 6).select("_item", F.xxhash64(F.array_join(F.slice("_w", 2, 4), " ")).alias("_key"))
    pairs = keys.join(long, "_key").select("_doc", "_item")
    if few.limit(most_short + 1).count() <= most_short:
        short = texts.join(F.broadcast(few), F.contains("_text", "_expected")).select("_doc", "_item")
    else:
        short = None
        sizes = sorted(r[0] for r in few.select(F.least(F.length("_expected"), F.lit(GRAM)).alias("n")).distinct().collect())  # GRAM + 1 at most
        for n in sizes:
            grams = texts.filter(F.length("_text") >= n).select("_doc", F.explode(_grams(F.col("_text"), n)).alias("_gram"))
            own = few.filter(F.least(F.length("_expected"), F.lit(GRAM)) == n).select("_item", F.substring("_expected", 1, n).alias("_gram"))
            pairs = pairs.union(written(grams, "grams").join(written(own, "item-grams"), "_gram").select("_doc", "_item"))
    found = pairs.distinct().join(texts, "_doc").join(asked.select("_item", "_expected"), "_item").filter(F.contains("_text", "_expected")).select("_doc", "_item")
    both = found if short is None else found.union(short)
    return both.select(F.col("_doc").alias(doc), F.col("_item").alias(item))
