"""Shaping of recognised pages: lines of characters in, verdicts and responses out.

Recognition itself is a user's function that gives ``lines``, an array with one struct of
parallel arrays (ch, conf, box) for each column of a page, null where nothing was read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions import scalar as S

#: The grade of a page without geometry, and the reason given without any (fixed values).
UNUSABLE = "못씀"
NOTHING_READ = "읽어 내지 못했습니다"


def kept_lines(lines: Column, marks: list[str], surviving: Column | None = None) -> Column:
    """Lines without nulls, their parallel arrays without the places of the marks.  With
    ``surviving``, an array of places from 0 that edge trimming left (null: it did not run),
    those lines alone and in that order; places that are not there give none."""
    if surviving is not None:
        lines = F.when(surviving.isNull(), lines).otherwise(F.transform(surviving, lambda i: F.get(lines, i)))

    def keep(line: Column) -> Column:
        cells = F.filter(F.arrays_zip(line.ch, line.conf, line.box), lambda z: ~z["ch"].isin(marks))
        return F.struct(*(cells.getField(c).alias(c) for c in ("ch", "conf", "box")))

    return F.transform(F.filter(lines, lambda x: x.isNotNull()), keep)


def confidences(lines: Column) -> Column:
    """All confidences of all lines, in order."""
    return F.flatten(F.transform(lines, lambda x: x.conf))


def characters(lines: Column) -> Column:
    return F.flatten(F.transform(lines, lambda x: x.ch))


def verdict(lines: Column, threshold: Column, grade: Column, reasons: Column, has_geometry: Column) -> Column:
    """struct(grade, reasons, text, marked_share, boxes, chars).  A page without characters
    has an empty text, the share 0, no ``chars``, and is unusable if it has no geometry."""
    conf = F.coalesce(confidences(lines), F.array().cast("array<double>"))
    n = F.size(conf)
    marked = F.size(F.filter(conf, lambda c: c < threshold))
    empty = n == 0
    return F.struct(
        F.when(empty & ~has_geometry, UNUSABLE).otherwise(grade).alias("grade"),
        F.when(empty & (F.size(reasons) == 0), F.array(F.lit(NOTHING_READ))).otherwise(reasons).alias("reasons"),
        F.when(empty, "").otherwise(F.array_join(F.transform(lines, lambda x: F.array_join(x.ch, "")), "\n")).alias("text"),
        F.when(empty, 0.0).otherwise(marked / n).alias("marked_share"), n.cast("long").alias("boxes"), F.when(~empty, n.cast("long")).alias("chars"),
    )


def blank_tiers(layout: Column, geometry: Column) -> Column:
    """The layout with the geometry's tiers and pitch ratio where that has blank tiers."""
    own = layout.withField("tiers", geometry.tiers).withField("ratio", geometry.pitch / geometry.xpitch)
    return F.when(F.coalesce(F.size(geometry.blank) > 0, F.lit(False)), own).otherwise(layout)


def seen_layout(layout: Column, geometry: Column) -> Column:
    """blank_tiers() with the blank tiers themselves and each tier's own ratio beside them,
    null where there are none."""
    some = F.coalesce(F.size(geometry.blank) > 0, F.lit(False))
    return blank_tiers(layout, geometry).withField("blank", F.when(some, geometry.blank)).withField("tier_ratios", F.when(some, geometry.tier_ratios))


def remapped(text: Column, candidates: Column) -> Column:
    """Candidates (start, end) in code points, in UTF-16 units."""
    return F.transform(candidates, lambda c: c.withField("start", S.utf16_offset(text, c.start)).withField("end", S.utf16_offset(text, c.end)))


def diagnosis(file: Column, page: Column, address: Column, path: Column, image: Column, chars: Column, reason: Column, **more: Column) -> Column:
    """Where a page came from, and what was read on it unless there is a reason not to.

    ``more`` adds what else is known, each under its own name: ``size`` (width, height) and
    ``build`` always, any other (detail, attempts) beside what was read."""
    read = F.coalesce(reason, F.lit("")) == ""
    text = F.array_join(chars, "")
    always = [more.pop(c).alias(c) for c in ("size", "build") if c in more]
    return F.struct(
        file.alias("file"), page.alias("page"), F.replace(address, F.lit("{N}"), page.cast("string")).alias("address"),
        S.fingerprint(path).alias("cache"), S.fingerprint(image).alias("image_hash"), *always,
        F.when(read, F.struct(F.size(chars).cast("long").alias("count"), S.fingerprint(text).alias("hash"), text.alias("text"), *(c.alias(k) for k, c in more.items()))).alias("ocr"),
    )


def compare_response(reason: Column, debug: Column, text: Column, candidates: Column, body: Column, **more: Column) -> Column:
    """struct(reason, known, debug, body, candidates) and what else the comparison found
    (agreement, wavering, wavering_columns, geometry, title, chars, attempts, detail), each
    under its own name; all after debug only without a reason."""
    fine = F.coalesce(reason, F.lit("")) == ""
    found = [F.when(fine, c).alias(k) for k, c in more.items()]
    return F.struct(reason.alias("reason"), F.lit(True).alias("known"), debug.alias("debug"), F.when(fine, body).alias("body"), F.when(fine, remapped(text, candidates)).alias("candidates"), *found)


def health(build: Column, threads: Column, cache: Column, inspected: Column, models: Column) -> Column:
    """What the service tells of itself; models is a map of those that are there to their titles."""
    return F.struct(build.alias("build"), threads.cast("int").alias("threads"), cache.alias("cache"), inspected.cast("long").alias("inspected"), models.alias("models"))
