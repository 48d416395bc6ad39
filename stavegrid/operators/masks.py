"""Set algebra of ink pixels and rectangles, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stavegrid.operators.durable import cut

_PIXEL = ["page_id", "y", "x"]


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(_PIXEL), _PIXEL, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(_PIXEL), _PIXEL, "left_anti")


def _in_rows(rectangles: DataFrame, pad_x: float, pad_y: float) -> DataFrame:
    """(page_id, y, lo, hi): the columns [lo, hi) that each padded rectangle
    (half-open) covers, row by row; the padded corners are cut towards zero, as
    the page's integer grid wants.  Pixels then meet only their own row's."""
    low, high = (lambda c, p: (F.col(c) - p).cast("int")), (lambda c, p: (F.col(c) + p).cast("int"))
    cut_ = rectangles.select("page_id", low("x0", pad_x).alias("lo"), high("x1", pad_x).alias("hi"), low("y0", pad_y).alias("top"), high("y1", pad_y).alias("end"))
    rows = cut_.where("end > top and hi > lo").select("page_id", F.explode(F.sequence(F.col("top"), F.col("end") - 1)).alias("y"), "lo", "hi")
    return rows.distinct()


def _covered(ink: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    i, r = ink.alias("i"), rows.alias("r")
    same = (F.col("i.page_id") == F.col("r.page_id")) & (F.col("i.y") == F.col("r.y"))
    return i.join(r, same & (F.col("i.x") >= F.col("r.lo")) & (F.col("i.x") < F.col("r.hi")), how)


def within(ink: DataFrame, rectangles: DataFrame, pad_x: float = 0, pad_y: float = 0) -> DataFrame:
    """Pixels in the union of the padded rectangles (page_id, x0, y0, x1, y1)."""
    return _covered(ink, _in_rows(rectangles, pad_x, pad_y), "left_semi")


def without(ink: DataFrame, rectangles: DataFrame, pad_x: float = 0, pad_y: float = 0) -> DataFrame:
    """Pixels outside all padded rectangles."""
    return _covered(ink, _in_rows(rectangles, pad_x, pad_y), "left_anti")


def erase_lines(ink: DataFrame, lines: DataFrame) -> DataFrame:
    """Ink without the bands around staff lines (page_id, y double, x0, x1, space):
    rows within max(1, 0.1 space) of the line, columns a space beyond its ends."""
    band = F.greatest(F.lit(1), F.rint(F.col("space") * 0.10).cast("int"))
    center, reach = F.rint("y").cast("int"), F.rint("space").cast("int")
    boxes = lines.select("page_id", (F.col("x0") - reach).alias("x0"), (center - band).alias("y0"), (F.col("x1") + reach).alias("x1"), (center + band + 1).alias("y1"))
    return without(ink, boxes)


def erase_marks(ink: DataFrame, ellipses: DataFrame, bars: DataFrame) -> DataFrame:
    """Ink without ellipses (page_id, cx, cy, rx, ry) and bars (page_id, x, y0, y1)
    two pixels wider on every side."""
    reach = F.ceil("ry").cast("int")
    rows = ellipses.select("page_id", "cx", "cy", "rx", "ry", F.explode(F.sequence(F.ceil(F.col("cy") - reach).cast("int"), F.floor(F.col("cy") + reach).cast("int"))).alias("y"))
    i, e = (lambda c: F.col(f"i.{c}")), (lambda c: F.col(f"e.{c}"))
    dx, dy = (i("x") - e("cx")) / e("rx"), (i("y") - e("cy")) / e("ry")
    hit = (i("page_id") == e("page_id")) & (i("y") == e("y")) & (dx * dx + dy * dy <= 1.0)
    left = ink.alias("i").join(rows.alias("e"), hit, "left_anti")
    boxes = bars.select("page_id", (F.col("x") - 2).alias("x0"), (F.col("y0") - 2).alias("y0"), (F.col("x") + 3).alias("x1"), (F.col("y1") + 3).alias("y1"))
    return without(left, boxes)


def label_runs(runs: DataFrame) -> DataFrame:
    """Runs (page_id, y, x0, x1) with ``label``, the least run number of their
    8-connected component on the page.

    Runs touch when their rows are neighbours and their ends are at most one
    apart.  Labels take their neighbours' least and then jump to their label's
    label, so the rounds grow with the logarithm of a component's extent.
    """
    order = Window.partitionBy("page_id").orderBy("y", "x0")
    runs = cut(runs.withColumn("id", F.row_number().over(order)))
    a, b = runs.alias("a"), runs.alias("b")
    touch = (F.col("a.page_id") == F.col("b.page_id")) & (F.col("b.y") == F.col("a.y") + 1) & (F.col("a.x0") <= F.col("b.x1") + 1) & (F.col("b.x0") <= F.col("a.x1") + 1)
    edges = a.join(b, touch).select("a.page_id", F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    edges = cut(edges.unionByName(edges.select("page_id", F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = runs.select("page_id", "id", F.col("id").alias("label"))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "v"), ["page_id", "v"]).groupBy("page_id", F.col("u").alias("id")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, ["page_id", "id"], "left").select("page_id", "id", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        up = hooked.select("page_id", F.col("id").alias("next"), F.col("next").alias("top"))
        labels = cut(hooked.join(up, ["page_id", "next"]).select("page_id", "id", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved")))
        if not labels.where("moved").limit(1).count():
            return runs.join(labels.select("page_id", "id", "label"), ["page_id", "id"]).drop("id")
        labels = labels.drop("moved")


def component_boxes(labelled: DataFrame) -> DataFrame:
    """(page_id, label, x0, y0, x1, y1, area): half-open boxes of components."""
    return labelled.groupBy("page_id", "label").agg(
        F.min("x0").alias("x0"), F.min("y").alias("y0"), (F.max("x1") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area")
    )


def clip_runs(runs: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Runs cut to the half-open region, before they are connected."""
    cutting = runs.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x1") >= x0) & (F.col("x0") < x1))
    return cutting.select("page_id", "y", F.greatest("x0", F.lit(x0)).alias("x0"), F.least("x1", F.lit(x1 - 1)).alias("x1"))


def drop_specks(runs: DataFrame, least: int = 3) -> DataFrame:
    """Runs of the components that have at least ``least`` pixels."""
    labelled = label_runs(runs)
    large = component_boxes(labelled).where(F.col("area") >= least).select("page_id", "label")
    return labelled.join(large, ["page_id", "label"], "left_semi").drop("label")
