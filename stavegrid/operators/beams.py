"""Beam links to beam groups: limits, vertex-disjoint paths, labels, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavegrid.functions import half_even
from stavegrid.operators.durable import cut
from stavegrid.params import DEFAULTS as P


def _length() -> Column:
    return F.greatest(F.lit(1), F.col("x1") - F.col("x0"))


def slope() -> Column:
    return (F.col("y1") - F.col("y0")) / _length()


def chosen_links(links: DataFrame, keys: list[str], space: Column) -> DataFrame:
    """Links (keys, left, right, gap, x0, y0, x1, y1, score, ..) with ``quality``, of
    which no two share a left or a right end.

    A link spans one or two stems in order of x, is neither long nor steep, and
    loses quality for a stem it skips and for length.  Of each left end the best
    stays, then of each right end; ties go to the link further left, then to the
    smaller left.
    """
    length = _length()
    quality = F.round(F.col("score") - (0.14 * (F.col("gap") - 1) + 0.015 * F.greatest(F.lit(0.0), length / space - 2.8)), 6)
    out = links.where(F.col("gap").between(1, 2) & (length <= 4.8 * space) & (F.abs(slope()) <= 0.75)).withColumn("quality", quality).where("quality >= 0.58")
    for end in ("left", "right"):
        order = Window.partitionBy(*keys, end).orderBy(F.col("quality").desc(), "x0", "left", "x1")
        out = out.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    return out


def label_paths(links: DataFrame, keys: list[str]) -> DataFrame:
    """``links`` with ``path``, the left end of their path's first link, and ``place``
    along it, from 0.

    List ranking: each link points to the link before it, and pointers double
    until all of them are at their path's first link.  The rounds grow with the
    logarithm of the longest path; a round is one equi-join.
    """
    links = cut(links)
    before = links.select(*keys, F.col("right").alias("left"), F.col("left").alias("up"))
    state = links.select(*keys, "left").join(before, [*keys, "left"], "left")
    state = cut(state.select(*keys, "left", F.coalesce("up", "left").alias("ptr"), F.col("up").isNotNull().cast("int").alias("place")))
    while True:
        up = state.select(*keys, F.col("left").alias("ptr"), F.col("ptr").alias("next"), F.col("place").alias("more"))
        moved = state.join(up, [*keys, "ptr"])
        state = cut(moved.select(*keys, "left", F.col("next").alias("ptr"), (F.col("place") + F.col("more")).alias("place"), (F.col("next") != F.col("ptr")).alias("moved")))
        if not state.where("moved").limit(1).count():
            return links.join(state.select(*keys, "left", F.col("ptr").alias("path"), "place"), [*keys, "left"])
        state = state.drop("moved")


def split_paths(labelled: DataFrame, keys: list[str], tolerance: float = P.slope_break) -> DataFrame:
    """Labelled links with ``slope`` and ``segment``: a path breaks where a slope
    leaves the running median of its segment.

    An ordered fold over one path, whose state keeps the segment's slopes in
    order: a new one is put in its place, and the median is read off the middle.
    """
    item = F.struct("place", "left", F.round(slope(), 6).alias("slope"))
    listed = labelled.groupBy(*keys, "path").agg(F.array_sort(F.collect_list(item)).alias("p"))
    start = F.struct(F.expr("cast(array() as array<double>)").alias("ordered"), F.expr("cast(array() as array<int>)").alias("segments"))

    def step(state: Column, link: Column) -> Column:
        ordered, n, s = state["ordered"], F.size(state["ordered"]), link["slope"]
        median = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
        breaks = F.coalesce(F.abs(s - median) > tolerance, F.lit(True))
        placed = F.concat(F.filter(ordered, lambda v: v <= s), F.array(s), F.filter(ordered, lambda v: v > s))
        number = F.coalesce(F.get(state["segments"], F.size(state["segments"]) - 1), F.lit(-1))
        return F.struct(F.when(breaks, F.array(s)).otherwise(placed).alias("ordered"), F.concat(state["segments"], F.array((number + breaks.cast("int")).cast("int"))).alias("segments"))

    folded = listed.select(*keys, "path", "p", F.aggregate("p", start, step, lambda s: s["segments"]).alias("s"))
    each = folded.select(*keys, "path", F.explode(F.arrays_zip("p", "s")).alias("e"))
    each = each.select(*keys, "path", F.col("e.p.place").alias("place"), F.col("e.p.slope").alias("slope"), F.col("e.s").alias("segment"))
    return labelled.join(each, [*keys, "path", "place"])


def beam_groups(split: DataFrame, keys: list[str], space: Column) -> DataFrame:
    """(keys, path, segment, stems, points, x0, y0, x1, y1, slope, score, hit_ratio,
    density): one row a segment.  Stems and points run from the first link's left
    end over all right ends; the box is padded; the slope is the median, the rest
    are means."""
    link = F.struct("place", "left", "right", "x0", "y0", "x1", "y1")
    micro = lambda c: F.sum(F.round(F.col(c) * 1e12).cast("long")) / F.count("*") / 1e12  # noqa: E731  (whole numbers add up alike in any order)
    found = split.groupBy(*keys, "path", "segment").agg(
        F.array_sort(F.collect_list(link)).alias("l"), F.median("slope").alias("slope"), *[micro(c).alias(c) for c in ("score", "hit_ratio", "density")], F.first(space).alias("_space")
    )
    first = F.col("l")[0]
    stems = F.concat(F.array(first["left"]), F.transform("l", lambda k: k["right"]))
    points = F.concat(F.array(F.struct(first["x0"].alias("x"), first["y0"].alias("y"))), F.transform("l", lambda k: F.struct(k["x1"].alias("x"), k["y1"].alias("y"))))
    pad = F.greatest(F.lit(2), half_even(0.35 * F.col("_space")))
    drawn = found.withColumn("stems", stems).withColumn("points", points)
    edge = lambda f, c, sign: (f(F.transform("points", lambda p: p[c])) + sign * pad).alias(f"{c}{int(sign > 0)}")
    box = [edge(F.array_min, "x", -1), edge(F.array_min, "y", -1), edge(F.array_max, "x", 1), edge(F.array_max, "y", 1)]
    return drawn.select(*keys, "path", "segment", "stems", "points", *box, "slope", "score", "hit_ratio", "density")
