"""Requests from body to answer as one plan: rows carry their first error along.

A request passes its checks in the order of its operation; the first that it breaks gives
its code and error, and what comes later sees only rows without one.  Tables are met by
left joins whose keys are set only for rows that still stand; the others get keys of their
own, which match nothing and spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import bodies as B
from scanloom.functions import scalar as S
from scanloom.operators.requests import page_exists
from scanloom.sources import tables
from scanloom.sources.shared import written

#: Operations by path (fixed values), and those whose answers are stored.
PATHS = {"/api/read": "read", "/api/compare": "compare", "/api/boxes": "boxes", "/api/area-read": "area-read", "/api/edge": "edge"}
STORED = ("read", "compare", "area-read")
DEFAULT_MODEL = "hangul"
#: Answers above this are not stored, the others for so long (fixed values).
ANSWER_BYTES = 4 * 1024 * 1024
ANSWER_SECONDS = 120


def model_error(name: Column, models: dict[str, bool]) -> Column:
    """``model`` for an unknown name, ``model_file`` for a known one whose file is absent."""
    known = F.create_map(*(F.lit(x) for pair in models.items() for x in pair))
    there = F.try_element_at(known, name)
    return F.when(there.isNull(), "model").when(~there, "model_file")


def model_name(v: Column, k: Column) -> Column:
    """A request's model: the default if absent, null or otherwise empty; text for others."""
    given = F.when(k == "string", B.get(v, "string")).when(k.isNotNull() & (k != "null"), F.to_json(v))
    return F.when(given.isNull() | given.isin("", "0", "0.0", "false", "[]", "{}"), DEFAULT_MODEL).otherwise(given)


def _standing(column: Column) -> Column:
    """A join key for rows without an error; the others, and null ones, get one that nothing has."""
    return F.coalesce(F.when(F.col("error").isNull(), column), F.concat(F.lit("\0"), F.col("_req").cast("string")))


def _fail(df: DataFrame, error: Column, code: int = 400) -> DataFrame:
    """Set error and code where none is set yet."""
    open_ = df.withColumn("_now", F.when(F.col("error").isNull(), error))
    return open_.withColumns({"error": F.coalesce("error", "_now"), "code": F.when(F.col("_now").isNotNull(), F.lit(code)).otherwise(F.col("code"))}).drop("_now")


def _only(ops: tuple[str, ...], error: Column) -> Column:
    return F.when(F.col("op").isin(*ops), error)


def parsed(requests: DataFrame, threshold: float) -> DataFrame:
    """requests (req, method, path, body) with ``op`` and the fields of their bodies, each
    read once, and the errors that need no table: method, body, file and page, and the
    operation's own fields up to its first look at a table."""
    rows = requests.withColumnsRenamed({"req": "_req"}).withColumns({"op": F.try_element_at(F.create_map(*(F.lit(x) for p in PATHS.items() for x in p)), F.col("path")), "_body": tables.body(F.coalesce("body", F.lit("")))})
    method = F.when(F.col("method") == "OPTIONS", "options").when(F.col("method") != "POST", "method")
    size = F.octet_length("body") > tables.BODY_BYTES
    body = F.when(size, "length").when(F.col("_body").isNull(), "body")
    rows = rows.withColumn("error", F.coalesce(method, body)).withColumn("code", F.when(F.col("error") == "options", 204).when(F.col("error") == "method", 404).when(F.col("error").isNotNull(), 400))
    rows = B.file_and_page(rows.withColumnRenamed("error", "_early"), "_body")
    rows = rows.withColumn("code", F.when(F.col("_early").isNull() & F.col("error").isNotNull(), 400).otherwise(F.col("code"))).withColumn("error", F.coalesce("_early", "error")).drop("_early")
    rows = rows.withColumn("page", F.when(F.col("_body").isNotNull(), F.col("page")))
    rows = _fail(rows, F.when(F.col("op").isNull(), "path"), 404)
    names = ("model", "tiers", "threshold", "ratio", "width", "height", "x0", "x1", "boxes")
    rows = rows.withColumns({f"_{x}": B.field(F.col("_body"), x) for x in names})
    coordinates = {f"_c_{x}": B.coordinate(F.col(f"_{x}")) for x in ("width", "height", "x0", "x1")}
    kinds = ("model", "tiers", "threshold", "ratio", "width", "height")
    rows = rows.withColumns({f"_k_{x}": B.kind(F.col(f"_{x}")) for x in kinds})
    of = lambda x: (F.col(f"_{x}"), F.col(f"_k_{x}"))
    rows = rows.withColumns(coordinates | {
        "model": model_name(*of("model")), "_n": B.tier_count(*of("tiers")), "threshold": B.threshold(F.col("_threshold"), threshold, F.col("_k_threshold")), "ratio": B.ratio(F.col("_ratio"), k=F.col("_k_ratio")),
        "text": B.body_text(F.col("_body")), "spacing": B.spacing(F.col("_body")),
    })
    rows = B.box_list(rows.withColumnRenamed("error", "_early"), "_boxes").withColumnRenamed("error", "_wrong_boxes").withColumnRenamed("_early", "error")
    edge = F.when(F.col("_c_x0").isNull() | F.col("_c_x1").isNull(), "coordinate").when(~((F.col("_c_x0") >= 0) & (F.col("_c_x0") < F.col("_c_x1"))), "order").when(S.EDGE / (F.col("_c_x1") - F.col("_c_x0")) > S.EDGE_ZOOM, "zoom")
    own = F.coalesce(
        _only(("read",), F.when(F.col("threshold").isNull(), "threshold")), _only(("compare",), F.when(F.col("text").isNull(), "text")),
        _only(("boxes",), F.col("_wrong_boxes")), _only(("edge",), edge),
    )
    rows = _fail(rows, own)
    return rows.withColumn("bad_pos", F.when((F.col("op") == "boxes") & (F.col("error") == F.col("_wrong_boxes")), F.col("bad_pos"))).drop("_body", "_wrong_boxes", "_early", *(f"_{x}" for x in names), *(f"_k_{x}" for x in kinds[:4]))


def answered(
    requests: DataFrame, info: DataFrame, images: DataFrame, layouts: DataFrame, results: DataFrame, models: dict[str, bool],
    recognise: Callable[[DataFrame], DataFrame], threshold: float = 0.5, seconds: int = ANSWER_SECONDS,
) -> DataFrame:
    """One row a request: req, op, code, error, bad_pos, file, page, reused, answer, and for
    answers to store op, image, params and expires.

    requests (req, method, path, body, at in microseconds); info (file, multi, pages); images
    (file, page, width, height, image), the scans that could be fetched; layouts (file,
    tiers, ratio, read_ratio); results (op, image, params, expires, answer); models: known
    names and whether their files are there.  ``recognise`` adds ``answer`` (null: it failed,
    code 500) and ``reason`` (null: none) to rows with op, file, page, model, layout,
    threshold, ratio, text, spacing, boxes, x0, x1 and image that no stored answer serves.

    The checks of read and compare: layout (409 while there is none), tiers, model, file's
    metadata, page, scan; of area-read: model, ratio, metadata, page, scan, its size; of boxes:
    metadata, page, scan, boxes outside of it, model; of edge: metadata, page, scan, its width
    and height.  Null method, path or body are no POST, no path and an empty body.
    """
    # Written, so that bodies are parsed once whatever reads the rows, and the plan's code stays small.
    # Java doesn't compile methods above this size; Spark cuts the parsing into smaller ones instead.
    conf = requests.sparkSession.conf
    before = conf.get("spark.sql.codegen.hugeMethodLimit")
    conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    try:
        rows = written(parsed(requests.withColumns({"method": F.coalesce("method", F.lit("GET"))}), threshold), "requests")
    finally:
        conf.set("spark.sql.codegen.hugeMethodLimit", before)
    laid, area = ("read", "compare"), ("area-read",)
    known = layouts.groupBy(F.col("file").alias("_file")).agg(F.first(F.struct("tiers", "ratio", "read_ratio")).alias("_own"))
    rows = rows.join(known, _standing(F.when(F.col("op").isin(*laid), F.col("file"))) == F.col("_file"), "left").drop("_file")
    rows = _fail(rows, _only(laid, F.when(F.col("_own").isNull(), "layout")), 409)
    rows = _fail(rows, _only(laid, F.when(F.col("_n") == -1, "tiers")))
    wrong_model = model_error(F.col("model"), models)
    rows = _fail(rows, _only((*laid, *area), wrong_model))
    rows = _fail(rows, _only(area, F.when(F.col("ratio").isNull(), "ratio")))

    meta = info.groupBy(F.col("file").alias("_file")).agg(F.first(F.struct("multi", "pages")).alias("_meta"))
    rows = rows.join(meta, _standing(F.col("file")) == F.col("_file"), "left").drop("_file")
    rows = _fail(rows, F.when(F.col("_meta").isNull(), "missing").when(~page_exists(F.col("_meta.multi"), F.col("_meta.pages"), F.col("page")), "page"))
    scans = images.groupBy(F.col("file").alias("_file"), F.col("page").cast("long").alias("_page")).agg(F.first(F.struct("width", "height", "image")).alias("_scan"))
    rows = rows.join(scans, (_standing(F.col("file")) == F.col("_file")) & (F.coalesce("page", F.lit(0)) == F.col("_page")), "left").drop("_file", "_page")
    width, height = F.col("_scan.width"), F.col("_scan.height")
    differs = lambda asked, c, size: F.coalesce(F.col(asked) != "null", F.lit(False)) & ~F.coalesce(F.col(c) == size, F.lit(False))
    outside = B.first_outside(F.col("boxes"), width, height)
    tall = F.greatest(F.lit(8.0), F.bround(height * (S.EDGE / (F.col("_c_x1") - F.col("_c_x0"))))) > S.EDGE_HEIGHT
    rows = _fail(rows, F.coalesce(
        F.when(F.col("_scan").isNull(), "scan"), _only(area, F.when(differs("_k_width", "_c_width", width) | differs("_k_height", "_c_height", height), "size")),
        _only(("boxes",), F.when(outside.isNotNull(), "outside")), _only(("edge",), F.when(F.col("_c_x1") > width, "outside").when(tall, "height")),
    ))
    rows = rows.withColumn("bad_pos", F.when((F.col("op") == "boxes") & (F.col("error") == "outside"), outside).otherwise(F.col("bad_pos")))
    rows = _fail(rows, _only(("boxes",), wrong_model))

    automatic = F.col("_n").isNull()
    rows = rows.withColumn("layout", F.when(F.col("op").isin(*laid) & F.col("error").isNull(), B.with_tiers(F.col("_own"), F.col("_n"))))
    every = lambda *more: F.struct("file", "page", "layout", "model", *more)
    key = F.when(F.col("op") == "read", S.canonical(F.to_variant_object(every("threshold", automatic.alias("automatic"), "spacing")))).when(F.col("op") == "compare", S.canonical(F.to_variant_object(every("text")))).when(F.col("op") == "area-read", S.canonical(F.to_variant_object(F.struct("file", "page", "ratio", "model"))))
    rows = rows.withColumns({"params": F.when(F.col("error").isNull(), S.fingerprint(key, 64)), "image": F.when(F.col("error").isNull(), F.col("_scan.image"))})
    kept = results.groupBy(F.col("op").alias("_op"), F.col("image").alias("_image"), F.col("params").alias("_params")).agg(F.max_by(F.struct("expires", "answer"), "expires").alias("_kept"))
    same = (F.col("op") == F.col("_op")) & (F.coalesce("image", F.lit("")) == F.col("_image")) & (_standing(F.col("params")) == F.col("_params"))
    rows = rows.join(kept, same, "left").drop("_op", "_image", "_params").withColumn("reused", F.coalesce(F.col("_kept.expires") > F.col("at"), F.lit(False)))

    fresh = rows.filter("error is null and not reused").withColumns({"x0": F.col("_c_x0"), "x1": F.col("_c_x1")})
    done = recognise(fresh).withColumns({"code": F.when(F.col("answer").isNull(), 500).otherwise(200), "error": F.when(F.col("answer").isNull(), "server")})
    served = rows.filter("error is null and reused").withColumns({"answer": F.col("_kept.answer"), "reason": F.lit(None).cast("string"), "code": F.lit(200)})
    failed = rows.filter("error is not null").withColumns({"answer": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
    columns = [F.col("_req").alias("req"), "op", "code", F.nullif(F.col("error"), F.lit("options")).alias("error"), "bad_pos", "file", "page", "reused", "answer", "reason", "image", "params", "at"]
    all_ = done.select(*columns).union(served.select(*columns)).union(failed.select(*columns))
    store = F.col("op").isin(*STORED) & (F.col("code") == 200) & ~F.col("reused") & (F.coalesce("reason", F.lit("")) == "") & (F.octet_length("answer") <= ANSWER_BYTES)
    return all_.withColumn("expires", F.when(store, F.col("at") + seconds * 1_000_000)).drop("at", "reason")


def to_store(answers: DataFrame) -> DataFrame:
    """The results that answers add: op, image, params, expires, answer."""
    return answers.filter("expires is not null").select("op", "image", "params", "expires", "answer")
