"""Histograms, projections and exact statistics of rasters, page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavegrid.params import DEFAULTS


def otsu_threshold(gray: DataFrame, default: int = DEFAULTS.otsu_default) -> DataFrame:
    """(page_id, otsu): the level that parts a page's histogram with the most
    variance between the sides; the lowest of equal levels; ``default`` for a
    page of one level.

    Only levels that occur can be best first, so 256 counts a page at most go
    into the running sums.
    """
    counts = gray.groupBy("page_id", "g").agg(F.count("*").cast("double").alias("n"))
    run = Window.partitionBy("page_id").orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    page = Window.partitionBy("page_id")
    sums = counts.select("page_id", "g", F.sum("n").over(run).alias("wb"), F.sum(F.col("n") * F.col("g")).over(run).alias("sb"), F.sum("n").over(page).alias("w"), F.sum(F.col("n") * F.col("g")).over(page).alias("s"))
    gap = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / (F.col("w") - F.col("wb"))
    between = F.when(F.col("w") > F.col("wb"), F.col("wb") * (F.col("w") - F.col("wb")) * gap * gap)
    best = F.max_by(F.when(between.isNotNull(), F.col("g")), F.struct(F.coalesce(between, F.lit(-1.0)), -F.col("g")))
    return sums.groupBy("page_id").agg(F.coalesce(best, F.lit(default)).cast("int").alias("otsu"))


def ink_threshold(otsu: Column, offset: int = DEFAULTS.ink_offset, low: int = DEFAULTS.ink_low, high: int = DEFAULTS.ink_high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), otsu + offset))


def binarize(gray: DataFrame, offset: int = DEFAULTS.ink_offset, low: int = DEFAULTS.ink_low, high: int = DEFAULTS.ink_high) -> DataFrame:
    """(page_id, y, x) of the pixels darker than their page's threshold.
    Thresholds are a row a page; Catalyst picks how to join them."""
    levels = otsu_threshold(gray).select("page_id", ink_threshold(F.col("otsu"), offset, low, high).alias("t"))
    return gray.join(levels, "page_id").where("g < t").select("page_id", "y", "x")


def row_projection(ink: DataFrame, rows: DataFrame) -> DataFrame:
    """(page_id, y, n): ink of every row of ``rows``, rows without any too."""
    counts = ink.groupBy("page_id", "y").agg(F.count("*").alias("n"))
    return rows.join(counts, ["page_id", "y"], "left").select("page_id", "y", F.coalesce("n", F.lit(0)).alias("n"))


def column_projection(ink: DataFrame, y0: int, y1: int) -> DataFrame:
    """(page_id, x, n): ink by column within rows [y0, y1)."""
    return ink.where((F.col("y") >= y0) & (F.col("y") < y1)).groupBy("page_id", "x").agg(F.count("*").alias("n"))


def strong_rows(projection: DataFrame, share: float = DEFAULTS.line_percentile) -> DataFrame:
    """(page_id, strong): exact percentile of the row sums, with interpolation."""
    return projection.groupBy("page_id").agg(F.percentile("n", F.lit(share)).alias("strong"))


def centroid(position: Column, weight: Column) -> Column:
    """Aggregate: weighted mean position."""
    return F.sum(position * weight) / F.greatest(F.lit(1), F.sum(weight))


def dilate_rows(runs: DataFrame) -> DataFrame:
    """Runs (page_id, y, x0, x1) also on the rows above and below."""
    return runs.select("page_id", F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1)).alias("y"), "x0", "x1").distinct()


def mode_and_median(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mode, median): mode of the values rounded half to even, the lowest
    of equals; exact median of the values."""
    rounded = values.groupBy(key, F.rint(value).cast("int").alias("v")).agg(F.count("*").alias("n"))
    mode = rounded.groupBy(key).agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("mode"))
    return mode.join(values.groupBy(key).agg(F.median(value).alias("median")), key)
