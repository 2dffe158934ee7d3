"""The inspection of files: measures of sampled pages, what fails, and the layout they give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.requests import even_pages

#: Pages of the two samples, and those read to pick the reading ratio (fixed values).
FIRST_PAGES = 12
SECOND_PAGES = 8
PICK_PAGES = 3


def sampled(files: DataFrame) -> DataFrame:
    """Each page that an inspection of files (file, multi, pages) looks at, once: ``at`` in
    their order, and in which sample it is.  Files of unknown length have none."""
    n = F.when(F.col("multi"), F.col("pages")).otherwise(F.lit(0)).cast("int")
    lists = files.select("file", n.alias("n")).filter("n > 0").select("file", even_pages(F.col("n"), FIRST_PAGES).alias("_a"), even_pages(F.col("n"), SECOND_PAGES).alias("_b"))
    pages = lists.select("file", "_a", "_b", F.posexplode(F.array_union("_a", "_b")).alias("at", "page"))
    return pages.select("file", "at", "page", F.array_contains("_a", F.col("page")).alias("in_first"), F.array_contains("_b", F.col("page")).alias("in_second"))


def inspected(
    files: DataFrame, measures: DataFrame, decide: Callable[[Column, Column], Column], estimate: Callable[[Column, Column], Column],
    frame: Callable[[Column], Column], pick: Callable[[Column, Column, Column, Column], Column],
) -> DataFrame:
    """One row a file: file, state (done or failed), message, tiers, ratio, frame, read_ratio,
    measured (pages without failure) and failed_pages.

    files (file, multi, pages): of several rows of a file the greatest counts.  measures (file, page, image, gap, tier, columns,
    failed, client): what a user's functions found on the pages; failed names the step at
    which a page broke (fetch, gap, tier or columns), client is a message that ends the
    whole inspection.  Pages without measures count as not fetched; of several rows of a
    page the greatest counts.

    A page that breaks gives neither gap nor tier; it keeps its image if it broke at its
    columns only.  A step is taken only for the samples it is of: gap for the first, tier
    and image for the second.  A client's message fails the file, the first page's in order.
    Single images and files of unknown length are done with one tier and no more.

    Four functions of columns stand for the recogniser: ``decide(gaps, tiers)`` over the two
    samples' measures (null where a page broke) gives the tiers; ``estimate(pages, tiers)``
    over pages of the second sample with an image a ratio or null; ``frame(columns)`` over
    the unbroken pages' columns in order; ``pick(pages, ratio, tiers, frame)`` the reading
    ratio from at most three pages, kept if it is not the ratio.
    """
    one = files.groupBy("file").agg(F.max(F.struct("multi", "pages")).alias("x")).select("file", "x.*")
    found = measures.groupBy("file", "page").agg(F.max(F.struct("image", "gap", "tier", "columns", "failed", "client")).alias("m"))
    rows = sampled(one).join(found, ["file", "page"], "left")
    skipped = ((F.col("m.failed") == "gap") & ~F.col("in_first")) | ((F.col("m.failed") == "tier") & ~F.col("in_second"))
    rows = rows.withColumn("_failed", F.when(F.col("m").isNull(), "fetch").when(~F.coalesce(skipped, F.lit(False)), F.col("m.failed")))
    fine = F.col("_failed").isNull()
    page = F.struct(
        "at", "page", "in_first", "in_second", fine.alias("fine"), F.when(fine, F.col("m.gap")).alias("gap"), F.when(fine, F.col("m.tier")).alias("tier"), F.when(fine, F.col("m.columns")).alias("columns"),
        (F.coalesce(fine | (F.col("_failed") == "columns"), F.lit(False)) & F.col("m.image").isNotNull()).alias("kept"), F.col("m.client").alias("client"),
    )
    # Twenty pages a file at most.
    files_ = rows.groupBy("file").agg(F.sort_array(F.collect_list(page)).alias("p"))
    by_page = lambda p, flag: F.array_sort(F.filter(p, lambda x: x[flag]), lambda a, b: F.when(a["page"] < b["page"], -1).when(a["page"] > b["page"], 1).otherwise(0))
    p = F.col("p")
    steps = one.join(files_, "file", "left").withColumns({
        "_gaps": F.transform(by_page(p, "in_first"), lambda x: x["gap"]), "_tiers": F.transform(by_page(p, "in_second"), lambda x: x["tier"]),
        "_images": F.transform(F.filter(by_page(p, "in_second"), lambda x: x["kept"]), lambda x: x["page"]), "_frames": F.transform(F.filter(p, lambda x: x["fine"]), lambda x: x["columns"]),
        "message": F.get(F.transform(F.filter(p, lambda x: x["client"].isNotNull()), lambda x: x["client"]), F.lit(0)),
    })
    counted = F.col("p").isNotNull() & F.col("message").isNull()
    steps = steps.withColumn("tiers", F.when(counted, decide(F.col("_gaps"), F.col("_tiers"))).when(F.col("p").isNull(), F.array().cast("array<double>")))
    steps = steps.withColumns({"ratio": F.when(counted, F.nullif(estimate(F.col("_images"), F.col("tiers")), F.lit(0.0))), "frame": F.when(counted, frame(F.col("_frames")))})
    picked = F.when(F.col("ratio").isNotNull(), pick(F.slice("_images", 1, PICK_PAGES), F.col("ratio"), F.col("tiers"), F.col("frame")))
    size = lambda keep: F.coalesce(F.size(F.filter(p, keep)), F.lit(0)).cast("long")
    return steps.withColumn("_picked", picked).select(
        "file", F.when(F.col("message").isNull(), "done").otherwise("failed").alias("state"), "message", "tiers", "ratio", "frame", F.nullif(F.col("_picked"), F.col("ratio")).alias("read_ratio"),
        F.when(F.col("p").isNull(), F.lit(0)).otherwise(size(lambda x: x["fine"])).cast("long").alias("measured"), F.when(F.col("p").isNull(), F.lit(0)).otherwise(size(lambda x: ~x["fine"])).cast("long").alias("failed_pages"),
    )
