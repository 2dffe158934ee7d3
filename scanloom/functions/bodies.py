"""Column expressions over request bodies given as VARIANT.

A field that fails its rule gives null or an error name; the names are those of the rules:
``file``, ``page``, ``tiers``, ``boxes``, ``count``, ``shape``, ``coordinate``, ``order``,
``limit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import scalar as S

#: Limits of a list of boxes (fixed values).
MOST_BOXES = 20_000
PIXELS_EACH = 1_048_576
PIXELS_ALL = 16_777_216
MARGIN = 8
MOST_TIERS = 6
#: Whole numbers beyond this count as this: they break every limit, and sums of a few fit.
LARGEST = 1 << 60
#: Words that leave the tiers to the layout (fixed values).
AUTOMATIC = ("", "auto", "자동")
KINDS = "VO:null,BO:bool,BI:int,ST:string,AR:list,OB:object"


def field(body: Column, key: str) -> Column:
    """A field as VARIANT: SQL null if absent, a variant null if given as null."""
    return F.try_variant_get(body, f"$['{key}']", "variant")


def kind(v: Column) -> Column:
    """null, bool, int, float, string, list or object; SQL null for an absent field.  The
    functions below take it as ``k`` where a plan has it as a column already."""
    name = F.substring(F.schema_of_variant(v), 1, 2)  # the types' first letters
    return F.when(v.isNotNull(), F.coalesce(F.try_element_at(F.str_to_map(F.lit(KINDS)), name), F.lit("float")))


def get(v: Column, type_: str) -> Column:
    return F.try_variant_get(v, "$", type_)


def whole_text(text: Column) -> Column:
    """A whole number written as text: blanks around it, a sign and underscores between
    digits are taken; null for anything else.  Beyond +-LARGEST it counts as that."""
    t = S.strip(text)
    n = F.replace(t, F.lit("_"), F.lit(""))
    far = F.when(t.startswith("-"), F.lit(-LARGEST)).otherwise(F.lit(LARGEST))
    return F.when(t.rlike(r"\A[+-]?[0-9]+(_[0-9]+)*\z"), F.coalesce(_bounded(n.try_cast("long")), far))


def _bounded(n: Column) -> Column:
    """n no further from 0 than LARGEST; null stays null."""
    return F.when(n > LARGEST, F.lit(LARGEST)).when(n < -LARGEST, F.lit(-LARGEST)).otherwise(n)


def number_text(text: Column) -> Column:
    """A finite number written as text, else null."""
    t = S.strip(text)
    return F.when(t.rlike(r"\A[+-]?([0-9]+(_[0-9]+)*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))


def number(v: Column, booleans: bool, k: Column | None = None) -> Column:
    """A number, or a text that is one, as double; true is 1 if booleans count."""
    k = kind(v) if k is None else k
    as_bool = get(v, "boolean").cast("double") if booleans else F.lit(None).cast("double")
    return F.when(k.isin("int", "float"), get(v, "double")).when(k == "string", number_text(get(v, "string"))).when(k == "bool", as_bool)


def coordinate(v: Column) -> Column:
    """A whole number, given as such or as a float without fraction, else null; beyond
    +-LARGEST it counts as that."""
    x, t = get(v, "double"), F.schema_of_variant(v)
    whole = t.rlike("^(DECIMAL|DOUBLE|FLOAT)") & (x == F.rint(x)) & (F.abs(x) < float("inf"))
    return F.when(t == "BIGINT", _bounded(get(v, "long"))).when(whole, _bounded(x).cast("long"))


def _filled(v: Column, k: Column) -> Column:
    """Whether a field is given and neither empty, zero, false nor null."""
    return (
        F.when(k == "string", get(v, "string") != "").when(k.isin("int", "float"), get(v, "double") != 0).when(k == "bool", get(v, "boolean"))
        .when(k.isin("list", "object"), ~F.to_json(v).isin("[]", "{}")).otherwise(F.lit(False))
    )


def file_and_page(df: DataFrame, body: str) -> DataFrame:
    """df with ``file``, ``page`` and ``error`` of the VARIANT column body.  file falls back to
    its other name when empty; page does so only when absent, and is 1 if both are; an
    explicit null is an error."""
    # In steps, so that each field is read and classified once.
    steps = df.withColumns({"_first": field(F.col(body), "file"), "_second": field(F.col(body), "파일"), "_asked": F.coalesce(field(F.col(body), "page"), field(F.col(body), "쪽"))})
    steps = steps.withColumns({"_k1": kind(F.col("_first")), "_k2": kind(F.col("_second")), "_ka": kind(F.col("_asked"))})
    one, two = _filled(F.col("_first"), F.col("_k1")), _filled(F.col("_second"), F.col("_k2"))
    text = lambda c, k: F.when(F.col(k) == "string", get(F.col(c), "string"))
    steps = steps.withColumn("_raw", F.when(one, text("_first", "_k1")).when(two, text("_second", "_k2")))
    asked = F.col("_asked")
    page = F.when(asked.isNull(), F.lit(1).cast("long")).when(F.col("_ka") == "string", whole_text(get(asked, "string"))).otherwise(coordinate(asked))
    steps = steps.withColumns({"file": F.nullif(S.file_name(F.col("_raw")), F.lit("")), "page": page})
    error = F.when(F.col("file").isNull(), "file").when(F.col("page").isNull() | (F.col("page") < 1), "page")
    return steps.withColumn("error", error).withColumn("page", F.when(F.col("page") >= 1, F.col("page"))).drop("_first", "_second", "_asked", "_k1", "_k2", "_ka", "_raw")


def tier_count(v: Column, k: Column | None = None) -> Column:
    """How many tiers a request asks for: null for the layout's own, -1 for a bad value."""
    k = kind(v) if k is None else k
    automatic = k.isNull() | (k == "null") | ((k == "string") & get(v, "string").isin(*AUTOMATIC))
    n = F.when(k == "string", whole_text(get(v, "string"))).when(k == "bool", get(v, "boolean").cast("long")).when(get(v, "double").between(1, MOST_TIERS + 1), F.floor(get(v, "double")).cast("long"))
    return F.when(automatic, F.lit(None)).when(n.between(1, MOST_TIERS), n).otherwise(F.lit(-1)).cast("int")


def with_tiers(layout: Column, n: Column) -> Column:
    """The layout with n equal tiers instead of its own, its other fields kept."""
    return F.when(n.isNull(), layout).otherwise(layout.withField("tiers", S.tiers(n)))


def ratio(v: Column, default: float = S.DEFAULT_RATIO, k: Column | None = None) -> Column:
    """A positive finite ratio; the default if none is given; null for a bad one."""
    k = kind(v) if k is None else k
    x = F.when(v.isNull() | (k == "null"), F.lit(default)).otherwise(number(v, True, k))
    return F.when(~F.isnan(x) & (x > 0) & (x < float("inf")), x)


def threshold(v: Column, default: float, k: Column | None = None) -> Column:
    """A threshold of 0 to 1, truth values excluded; the default if absent; null if bad."""
    x = F.when(v.isNull(), F.lit(default)).otherwise(number(v, False, k))
    return F.when(~F.isnan(x) & x.between(0, 1), x)


def body_text(body: Column) -> Column:
    """The text to compare: ``text`` unless null or absent, else ``본문``; null if no string."""
    text = field(body, "text")
    chosen = F.when(text.isNotNull() & (kind(text) != "null"), text).otherwise(field(body, "본문"))
    return F.when(kind(chosen) == "string", get(chosen, "string"))


def spacing(body: Column) -> Column:
    """On unless the field is exactly false."""
    v = field(body, "spacing")
    return ~F.coalesce((kind(v) == "bool") & ~get(v, "boolean"), F.lit(False))


def box_list(df: DataFrame, column: str) -> DataFrame:
    """df with ``boxes``, ``bad_pos`` and ``error`` of the VARIANT column: a list of
    [x0, y0, x1, y1]; an absent one is empty.

    The first box that breaks a rule ends it: its place from 0 and the rule.  At most
    MOST_BOXES boxes are looked at, as longer lists are refused."""
    v, nothing = F.col(column), F.array().cast("array<variant>")

    def parsed(b: Column) -> Column:
        return F.transform(get(b, "array<variant>"), coordinate)

    def step(a: Column, b: Column) -> Column:
        x0, y0, x1, y1 = (F.get(b, F.lit(i)) for i in range(4))
        # As doubles, which hold any product of four such numbers.
        area = ((x1 - x0).cast("double") + MARGIN) * ((y1 - y0).cast("double") + MARGIN)
        total = a.total + F.coalesce(area, F.lit(0.0))
        error = (
            F.when(F.coalesce(F.size(b), F.lit(-1)) != 4, "shape").when(x0.isNull() | y0.isNull() | x1.isNull() | y1.isNull(), "coordinate")
            .when(~((x0 >= 0) & (x0 < x1) & (y0 >= 0) & (y0 < y1)), "order").when((area > PIXELS_EACH) | (total > PIXELS_ALL), "limit")
        )
        return F.when(a.error.isNotNull(), a).otherwise(F.struct((a.pos + 1).alias("pos"), total.alias("total"), error.alias("error")))

    start = F.struct(F.lit(-1).alias("pos"), F.lit(0.0).alias("total"), F.lit(None).cast("string").alias("error"))
    steps = df.withColumn("_items", F.when(v.isNull(), nothing).otherwise(get(v, "array<variant>")))
    steps = steps.withColumn("_wrong", F.when(v.isNotNull() & (kind(v) != "list"), "boxes").when(F.size("_items") > MOST_BOXES, "count"))
    steps = steps.withColumn("_boxes", F.transform(F.when(F.col("_wrong").isNull(), F.col("_items")).otherwise(nothing), parsed))
    steps = steps.withColumn("_end", F.aggregate("_boxes", start, step))
    steps = steps.withColumn("error", F.coalesce("_wrong", "_end.error")).withColumn("bad_pos", F.when(F.col("_wrong").isNull() & F.col("_end.error").isNotNull(), F.col("_end.pos")))
    plain = F.transform("_boxes", lambda b: F.struct(*(F.get(b, F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1")))))
    return steps.withColumn("boxes", F.when(F.col("error").isNull(), plain)).drop("_items", "_wrong", "_boxes", "_end")


def first_outside(boxes: Column, width: Column, height: Column) -> Column:
    """Place from 0 of the first box that leaves the image; null if none does."""
    at = F.array_position(F.transform(boxes, lambda b: (b.x1 > width) | (b.y1 > height)), F.lit(True))
    return F.when(at > 0, (at - 1).cast("int"))


def size_differs(asked_width: Column, asked_height: Column, width: Column, height: Column) -> Column:
    """Whether the size a client gives, if it does, is not the image's."""
    return F.coalesce(asked_width != width, F.lit(False)) | F.coalesce(asked_height != height, F.lit(False))
