"""Two-column pages: where the gutter is, and reading the left column before the right one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions.let import computed
from foliospark.model import DocSet

MIN_ELEMENTS, MIN_SIDE, WIDE, NARROW, TINY = 6, 3, 0.6, 0.15, 0.10
LOW, HIGH, MIN_GUTTER, CONFIDENCE, PROPAGATE = 0.3, 0.7, 5.0, 0.6, 0.4


def _boxes(d: DocSet) -> DataFrame:
    p = d.pages.select("doc_id", "page_number", F.col("width").alias("pw"))
    e = d.elements.filter("type = 'text' and bbox is not null").select("doc_id", "page_number", F.col("bbox.x0").alias("x0"), F.col("bbox.x1").alias("x1"))
    return e.join(p, ["doc_id", "page_number"]).filter("pw > 0").withColumn("w", F.col("x1") - F.col("x0"))


def detect_columns(d: DocSet) -> DataFrame:
    """(doc_id, page_number, gutter_x, gutter_width, left_right, right_right, confidence) of pages with two columns by themselves.

    The gutter is the first of about 80 places across the middle of the page that the fewest column-wide boxes cross, two at most.
    A page's boxes are an array that each place counts, so places and boxes never meet as rows.
    """
    page = _boxes(d).filter((F.col("w") <= F.col("pw") * WIDE) & (F.col("w") >= F.col("pw") * NARROW)).groupBy("doc_id", "page_number", "pw").agg(F.count("*").alias("n"), F.collect_list(F.struct("x0", "x1")).alias("bs")).filter(F.col("n") >= MIN_ELEMENTS)
    step = F.greatest(F.lit(1.0), F.col("pw") / 200)
    places = F.transform(F.sequence(F.lit(0), F.floor((F.col("pw") * HIGH - F.col("pw") * LOW) / step).cast("int")), lambda k: F.col("pw") * LOW + k * step)
    counted = F.transform(places, lambda x: F.struct(F.size(F.filter(F.col("bs"), lambda b: (b.x0 <= x) & (b.x1 >= x))).alias("crossing"), x.alias("x")))
    page = computed(page, best=F.array_min(counted)).filter(F.col("best.crossing") <= 2)
    x = F.col("best.x")
    side = F.filter("bs", lambda b: ~((b.x0 < x) & (b.x1 > x)))
    middle = lambda b: (b.x0 + b.x1) / 2
    page = computed(page, left=F.filter(side, lambda b: middle(b) < x), right=F.filter(side, lambda b: middle(b) >= x)).filter((F.size("left") >= MIN_SIDE) & (F.size("right") >= MIN_SIDE))
    lr, rl = F.array_max(F.transform("left", lambda b: b.x1)), F.array_min(F.transform("right", lambda b: b.x0))
    page = computed(page, left_right=lr, right_left=rl, right_right=F.array_max(F.transform(F.filter("bs", lambda b: middle(b) > x), lambda b: b.x1)))
    page = page.withColumn("gutter_x", (F.col("left_right") + F.col("right_left")) / 2).withColumn("gw", F.col("right_left") - F.col("left_right"))
    conf = F.when(F.abs(F.col("gutter_x") / F.col("pw") - 0.5) > 0.15, 0.7).otherwise(1.0) * F.when(F.col("gw") < MIN_GUTTER, 0.5).otherwise(1.0) * F.when(F.col("best.crossing") == 0, 1.0).otherwise(0.7)
    return computed(page, confidence=conf).filter(F.col("confidence") >= CONFIDENCE).select("doc_id", "page_number", "gutter_x", F.greatest("gw", F.lit(0.0)).alias("gutter_width"), "left_right", F.coalesce("right_right", "right_left").alias("right_right"), "confidence")


def page_layout(d: DocSet) -> DataFrame:
    """detect_columns(), and where two pages in five of a document or more have columns, their median gutter tried on the others, by laxer rules."""
    own = detect_columns(d)
    n = d.pages.groupBy("doc_id").agg(F.count("*").alias("__n"))
    hint = own.groupBy("doc_id").agg(F.count("*").alias("__k"), F.expr("percentile(gutter_x, 0.5)").alias("hint")).join(n, "doc_id").filter(F.col("__k") >= F.col("__n") * PROPAGATE).select("doc_id", "hint")
    b = _boxes(d).join(own.select("doc_id", "page_number"), ["doc_id", "page_number"], "left_anti").join(hint, "doc_id")
    fits = F.col("w") <= F.col("pw") * WIDE
    apart = fits & (F.col("w") >= F.col("pw") * TINY) & ~((F.col("x0") < F.col("hint")) & (F.col("x1") > F.col("hint")))
    mid = (F.col("x0") + F.col("x1")) / 2
    n_if = lambda c: F.sum(F.when(c, 1).otherwise(0))
    page = b.groupBy("doc_id", "page_number", "hint").agg(
        F.count("*").alias("n"), n_if(fits & (F.col("w") >= F.col("pw") * NARROW)).alias("columns"), n_if(F.col("w") < F.col("pw") * NARROW).alias("tiny"),
        F.max(F.when(apart & (mid < F.col("hint")), F.col("x1"))).alias("left_right"), F.min(F.when(apart & (mid >= F.col("hint")), F.col("x0"))).alias("right_left"), F.max(F.when(fits & (mid > F.col("hint")), F.col("x1"))).alias("right_right"),
    )
    page = page.filter((F.col("n") >= 2) & (F.col("columns") >= 2) & (F.col("tiny") <= F.col("columns") * 1.5) & F.col("left_right").isNotNull() & F.col("right_left").isNotNull())
    more = page.select("doc_id", "page_number", F.col("hint").alias("gutter_x"), F.greatest(F.col("right_left") - F.col("left_right"), F.lit(0.0)).alias("gutter_width"), "left_right", F.coalesce("right_right", F.col("hint") + 50).alias("right_right"), F.lit(0.5).alias("confidence"))
    return own.unionByName(more)


def reading_order(d: DocSet, layout: DataFrame | None = None) -> DocSet:
    """Pages with a layout read zone by zone, which boxes across the gutter part: left column, then right, each from the top. seq is numbered anew there."""
    layout = page_layout(d) if layout is None else layout
    p = layout.join(d.pages.select("doc_id", "page_number", F.col("width").alias("__pw")), ["doc_id", "page_number"]).select("doc_id", "page_number", "__pw", F.col("gutter_x").alias("__g"), F.col("left_right").alias("__l"), F.col("right_right").alias("__r"))
    e = d.elements.join(p, ["doc_id", "page_number"], "left")
    b = F.col("bbox")
    across = (G.width(b) > F.col("__pw") * WIDE) | ((b.x0 < F.col("__g")) & (b.x1 > F.col("__g")))
    column = F.when(b.isNull(), "left").when(across, "full_width").when(G.center_x(b) < F.col("__g"), "left").otherwise("right")
    right = F.when(F.col("column") == "left", F.col("__l")).when(F.col("column") == "right", F.col("__r")).otherwise(F.greatest("__l", "__r"))
    has = F.col("__g").isNotNull()
    e = e.withColumn("column", F.when(has, column).otherwise(F.col("column"))).withColumn("column_right", F.when(has, right).otherwise(F.col("column_right")))
    in_order = Window.partitionBy("doc_id", "page_number").orderBy("seq")
    full = (F.col("column") == "full_width").cast("int")
    # A full-width box ends a zone and comes after it.
    e = e.withColumn("__zone", F.sum(full).over(in_order) - full).withColumn("__rank", F.when(full == 1, 2).when(F.col("column") == "right", 1).otherwise(0))
    y, x = F.coalesce(b.y0, F.lit(0.0)), F.coalesce(b.x0, F.lit(0.0))
    anew = Window.partitionBy("doc_id", "page_number").orderBy("__zone", "__rank", y, x, "seq")
    e = e.withColumn("seq", F.when(has, (F.row_number().over(anew) - 1).cast("double")).otherwise(F.col("seq")))
    return d.with_elements(e.select(*d.elements.columns))
