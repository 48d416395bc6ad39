"""Runs and islands: consecutive positions with bounded gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavegrid.params import DEFAULTS


def islands(points: DataFrame, keys: list[str], position: str, max_gap: float = 1, *also: Column) -> DataFrame:
    """(keys, start, end, n, also): positions whose step from the one before is
    at most ``max_gap`` share an island.  One shuffle: the aggregate reuses the
    window's partitioning."""
    order = Window.partitionBy(*keys).orderBy(position)
    step = F.col(position) - F.lag(position).over(order)
    marked = points.withColumn("_new", F.when(step <= max_gap, 0).otherwise(1))
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*keys, "_island").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count("*").alias("n"), *also).drop("_island")


def ink_runs(ink: DataFrame) -> DataFrame:
    """(page_id, y, x0, x1): horizontal runs, ends included."""
    return islands(ink, ["page_id", "y"], "x").select("page_id", "y", F.col("start").alias("x0"), F.col("end").alias("x1"))


def longest_run(points: DataFrame, keys: list[str], position: str, max_gap: int = 1) -> DataFrame:
    """(keys, start, end, length): the longest island, the first of equals."""
    runs = islands(points, keys, position, max_gap)
    length = F.col("end") - F.col("start") + 1
    return runs.groupBy(*keys).agg(F.max_by(F.struct("start", "end", length.alias("length")), F.struct(length, -F.col("start"))).alias("r")).select(*keys, "r.*")


def longest_column_run(ink: DataFrame, blanks: int = DEFAULTS.stem_gap_px) -> DataFrame:
    """(page_id, x, start, end, length): the longest vertical run of each column
    that bridges up to ``blanks`` empty pixels, so steps up to blanks + 1."""
    return longest_run(ink, ["page_id", "x"], "y", blanks + 1)


def projection_groups(ink: DataFrame, axis: str, threshold: int, max_gap: int = 1) -> DataFrame:
    """(page_id, groups): islands of columns (axis x) or rows (axis y) whose ink
    reaches the threshold; 0 for a page without any."""
    strong = ink.groupBy("page_id", axis).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    found = islands(strong, ["page_id"], axis, max_gap).groupBy("page_id").agg(F.count("*").alias("groups"))
    return ink.select("page_id").distinct().join(found, "page_id", "left").select("page_id", F.coalesce("groups", F.lit(0)).alias("groups"))


def long_runs(runs: DataFrame, regions: DataFrame, least: int) -> DataFrame:
    """(page_id, y, x0, x1): runs that, cut to their region (page_id, x0, y0, x1,
    y1; half-open), are still ``least`` long."""
    r, g = runs.alias("r"), regions.alias("g")
    inside = (F.col("r.page_id") == F.col("g.page_id")) & (F.col("r.y") >= F.col("g.y0")) & (F.col("r.y") < F.col("g.y1")) & (F.col("r.x1") >= F.col("g.x0")) & (F.col("r.x0") < F.col("g.x1"))
    cut = r.join(g, inside).select("r.page_id", "r.y", F.greatest("r.x0", "g.x0").alias("x0"), F.least(F.col("r.x1"), F.col("g.x1") - 1).alias("x1"))
    return cut.where(F.col("x1") - F.col("x0") + 1 >= least)
