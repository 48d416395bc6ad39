"""Text, accidentals, bars, stems, ledger lines, beam links and secondary symbols
of whole pages, as joins and folds keyed by page and staff.

``staves`` are rows (page_id, staff, top, bottom, space, x0, x1, scan_x0) and
perhaps clef boxes (clef_x0, clef_y0, clef_x1, clef_y1); ``pages`` rows
(page_id, height, width); ink rows (page_id, y, x).  Boxes are half-open.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stavegrid.functions import half_even
from stavegrid.operators import boxes, marks, masks
from stavegrid.operators.durable import cut
from stavegrid.operators.runs import ink_runs, islands
from stavegrid.operators.staves import pitch_distance
from stavegrid.params import DEFAULTS as P

KEYS = ["page_id", "staff"]
BOX = ["x0", "y0", "x1", "y1"]


def _s() -> Column:
    return F.col("space")


# --------------------------------------------------------- regions and their parts
def regions(staves: DataFrame, pages: DataFrame, left: Column, right: Column, above: float, below: float | None = None) -> DataFrame:
    """Staves with their region [rx0, rx1) x [ry0, ry1) on the page."""
    held = staves.join(pages, "page_id")
    y = half_even(F.col("top") - above * _s()), half_even(F.col("bottom") + (above if below is None else below) * _s())
    edge = [F.greatest(F.lit(0), half_even(left)), F.greatest(F.lit(0), y[0]), F.least("width", half_even(right)), F.least("height", y[1])]
    return held.select(*staves.columns, *[e.alias(n) for e, n in zip(edge, ("rx0", "ry0", "rx1", "ry1"))])


def connected_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """The number of the first run of each run's 8-connected part; runs in raster
    order, ends included.  Runs take the least number of those they touch on the
    next row, then their number's number, until nothing changes."""
    wide = int(x1.max(initial=0)) + 3
    low = np.searchsorted(y * wide + x1, (y + 1) * wide + x0 - 1, "left")
    n = np.maximum(np.searchsorted(y * wide + x0, (y + 1) * wide + x1 + 1, "right") - low, 0)
    i = np.repeat(np.arange(len(y)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    label = np.arange(len(y))
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        for ends in (i, j):
            np.minimum.at(label, before[ends], least)
            np.minimum.at(label, ends, least)
        label = label[label]
        if (label == before).all():
            return label


def region_parts(runs: DataFrame, where: DataFrame) -> DataFrame:
    """(page_id, staff, seq, x0, y0, x1, y1, area): the 8-connected parts of the runs
    (page_id, y, x0, x1) cut to each staff's region, numbered by first pixel.

    A group is the runs of one staff's region.  For rasters without such regions
    :func:`stavegrid.operators.masks.label_runs` connects runs by joins."""
    r, g = runs.alias("r"), where.select(*KEYS, "rx0", "ry0", "rx1", "ry1").alias("g")
    inside = (F.col("r.page_id") == F.col("g.page_id")) & (F.col("r.y") >= F.col("ry0")) & (F.col("r.y") < F.col("ry1")) & (F.col("r.x1") >= F.col("rx0")) & (F.col("r.x0") < F.col("rx1"))
    cutting = r.join(g, inside).select("g.page_id", "g.staff", "r.y", F.greatest("r.x0", "rx0").alias("x0"), F.least(F.col("r.x1"), F.col("rx1") - 1).alias("x1"))
    types = dict(where.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in KEYS) + ", seq long, x0 int, y0 int, x1 int, y1 int, area long"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x0"], ignore_index=True)
        frame["area"] = frame["x1"] - frame["x0"] + 1
        label = connected_runs(*(frame[c].to_numpy(np.int64) for c in ("y", "x0", "x1")))
        parts = frame.groupby(label).agg(x0=("x0", "min"), y0=("y", "min"), x1=("x1", "max"), y1=("y", "max"), area=("area", "sum"))
        parts[["x1", "y1"]] += 1
        return parts.assign(seq=parts.index, **{k: frame[k].iloc[0] for k in KEYS})[[*KEYS, "seq", *BOX, "area"]]

    return cutting.groupBy(*KEYS).applyInPandas(run, schema)


def flagged(items: DataFrame, others: DataFrame, near: Callable, reach: Column, name: str, keys: list[str] = KEYS, cell: int = 64) -> DataFrame:
    """``items`` (keys, seq, x0, x1, ..) with ``name``: whether one of ``others`` (keys,
    ox0, ox1, ..) with the same keys is near.

    ``near(a, b)`` is held only against others that share a strip of ``cell``
    columns with the item widened by ``reach``, which must cover all near ones."""
    strips = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor(b / cell)))
    a = items.withColumn("_cell", strips(F.col("x0") - reach, F.col("x1") + reach)).alias("a")
    b = others.withColumn("_cell", strips(F.col("ox0"), F.col("ox1"))).alias("b")
    same = F.col("a._cell") == F.col("b._cell")
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    hit = a.join(b, same & near(marks.of("a"), marks.of("b")), "left_semi").select(*keys, "seq").distinct().withColumn(name, F.lit(True))
    return items.join(hit, [*keys, "seq"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def spans(others: DataFrame, left: str = "x0", right: str = "x1") -> DataFrame:
    """Others as :func:`flagged` wants them."""
    return others.withColumn("ox0", F.col(left)).withColumn("ox1", F.col(right))


def _without_text(items: DataFrame, text: DataFrame | None) -> DataFrame:
    """Items that do not meet a text region of their page, widened by its margin."""
    if text is None:
        return items
    a, b = items.alias("a"), text.select("page_id", *BOX).alias("b")
    meets = boxes.intersects(marks.of("a"), marks.of("b"), half_even(0.15 * F.col("a.space")))
    return a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & meets, "left_anti")


# ------------------------------------------------------------------------ text
def first_fit(centers: list[float], reach: float) -> list[int]:
    """For ascending centers the number of the first row whose median, as it is by
    then, is within reach; a new row where none is."""
    rows: list[list[float]] = []
    medians: list[float] = []
    out = []
    for c in centers:
        home = next((k for k, m in enumerate(medians) if abs(c - m) <= reach), len(rows))
        if home == len(rows):
            rows.append([])
            medians.append(c)
        row = rows[home]
        insort(row, c)
        medians[home] = (row[(len(row) - 1) // 2] + row[len(row) // 2]) / 2
        out.append(home)
    return out


def text_rows(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``parts`` (keys, seq, x0 .. y1, space) with ``text_row``: first fit into rows
    by height, in the order of middle, left side, seq.  A group is what a page's
    staff holds."""
    schema = StructType([*parts.schema.fields, StructField("text_row", IntegerType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(cy=(frame["y0"] + frame["y1"]) * 0.5).sort_values(["cy", "x0", "seq"])
        return frame.assign(text_row=first_fit(frame["cy"].tolist(), 0.58 * frame["space"].iloc[0])).drop(columns="cy")

    return parts.groupBy(*keys).applyInPandas(run, schema)


def text_regions(parts: DataFrame, where: DataFrame) -> DataFrame:
    """(page_id, staff, x0 .. y1, score, n, seq) from the parts of each staff: rows,
    phrases of three parts or more that are wide and flat and no notes on a
    pitch row, and of those that meet only the best."""
    return regions_of(parts.join(where.select(*KEYS, "top", "bottom", "space"), KEYS))


def regions_of(parts: DataFrame, pieces: int | None = None) -> DataFrame:
    """:func:`text_regions` of parts that carry their staff's top, bottom and space.

    ``pieces``: into how many partitions pages are dealt again once the parts have
    rows, since what Python returns is no longer dealt by anything; the session's
    number where there is none.
    """
    lined = text_rows(parts.where(marks.is_text_part(F.col, _s())), KEYS)
    if pieces:
        lined = lined.repartition(pieces, "page_id")
    held = marks.phrases(lined, [*KEYS, "top", "bottom", "space", "text_row"], _s())
    w, h, cy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), (F.col("y0") + F.col("y1")) * 0.5
    core = cy.between(F.col("top") - 0.35 * _s(), F.col("bottom") + 0.35 * _s()) & (pitch_distance(cy, F.col("top"), _s()) <= 0.22 * _s())
    held = held.where((F.col("n") >= 3) & (w >= 1.8 * _s()) & (h <= 2.15 * _s()) & ~core).withColumn("score", marks.phrase_score(F.col("n"), w, _s()))
    order = Window.partitionBy("page_id").orderBy("staff", "text_row", "phrase")
    held = held.withColumn("seq", F.row_number().over(order).cast("long"))
    return boxes.suppress_boxes(held, ["page_id"], ["staff", *BOX, "n"], 3)


def find_text(cleaned: DataFrame, staves: DataFrame, pages: DataFrame, accidentals: DataFrame | None = None) -> DataFrame:
    """Text regions of the ink that is no accidental."""
    source = cleaned if accidentals is None else masks.without(cleaned, accidentals.select("page_id", *BOX), 2, 2)
    where = regions(staves, pages, F.col("scan_x0") - 0.5 * _s(), F.col("x1") + 0.5 * _s(), 4.3)
    return text_regions(region_parts(ink_runs(source), where), where)


# ----------------------------------------------------------------- accidentals
def crop_projections(crops: DataFrame, runs: DataFrame) -> DataFrame:
    """``crops`` (page_id, staff, seq, x0 .. y1) with the islands of strong rows
    (``rows``) and columns (``columns``) of all ink in the box, and its number of
    tall columns (``tall``).

    A crop meets the runs of its own rows, an equi-join; no crop is a raster."""
    ids = [*KEYS, "seq"]
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sized = crops.select(*ids, "x0", "x1", *[F.greatest(F.lit(2), half_even(c)).alias(n) for n, c in (("least_row", 0.34 * w), ("least_column", 0.26 * h), ("least_tall", 0.48 * h))], F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"))
    r = runs.select("page_id", "y", F.col("x0").alias("a"), F.col("x1").alias("b"))
    held = sized.join(r, ["page_id", "y"]).where((F.col("b") >= F.col("x0")) & (F.col("a") < F.col("x1")))
    held = held.select(*ids, "y", "least_row", "least_column", "least_tall", F.greatest("a", "x0").alias("a"), F.least(F.col("b"), F.col("x1") - 1).alias("b"))
    rows = held.groupBy(*ids, "y", "least_row").agg(F.sum(F.col("b") - F.col("a") + 1).alias("n")).where("n >= least_row")
    columns = held.select(*ids, "least_column", "least_tall", F.explode(F.sequence("a", "b")).alias("x")).groupBy(*ids, "x", "least_column", "least_tall").agg(F.count("*").alias("n"))
    groups = lambda p, at, name: islands(p.select(*ids, at), ids, at).groupBy(*ids).agg(F.count("*").alias(name))
    out = crops.join(groups(rows, "y", "rows"), ids, "left").join(groups(columns.where("n >= least_column"), "x", "columns"), ids, "left")
    out = out.join(columns.where("n >= least_tall").groupBy(*ids).agg(F.count("*").alias("tall")), ids, "left")
    return out.fillna(0, ["rows", "columns", "tall"])


def find_accidentals(cleaned: DataFrame, staves: DataFrame, pages: DataFrame, text: DataFrame | None) -> DataFrame:
    """(page_id, staff, x0 .. y1, kind, score, density, seq): parts away from clef and
    text, merged where they are near, told by their crop's projections; none in a
    line of text; of those that meet only the best."""
    where = regions(staves, pages, F.col("scan_x0") - 0.7 * _s(), F.col("x1") + 0.25 * _s(), 3.2)
    runs = cut(ink_runs(cleaned))
    clefs = [c for c in staves.columns if c.startswith("clef_") and c != "clef_type"]
    every = cut(region_parts(runs, where)).join(staves.select(*KEYS, "space", *clefs), KEYS)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    parts = every.where((F.col("area") >= F.greatest(F.lit(5), (0.025 * _s() * _s()).cast("int"))) & (w <= 2.4 * _s()) & (h <= 3.9 * _s()))
    if clefs:
        clef = boxes.intersects(F.col, lambda c: F.col(f"clef_{c}"), half_even(0.2 * _s()))
        parts = parts.where(~F.coalesce(clef, F.lit(False)))
    parts = _without_text(parts, text).select(*KEYS, "seq", *BOX, "area", "space")
    merged = boxes.merge_boxes(parts, KEYS, 0.28 * _s(), 0.38 * _s())
    typed = marks.in_text_cluster(every, KEYS, _s()).withColumn("typed", F.lit(1))
    grouped = parts.join(merged, [*KEYS, "seq"]).join(typed, [*KEYS, "seq"], "left")
    crops = grouped.groupBy(*KEYS, F.col("grp").alias("seq")).agg(*boxes.hull(F.sum("area").alias("area"), F.count("typed").alias("typed")))
    told = crop_projections(crops.where("typed = 0"), runs).join(staves.select(*KEYS, "top", "space", "scan_x0", F.col("x1").alias("staff_x1")), KEYS)
    kind = marks.accidental_kind(F.col("rows"), F.col("columns"), F.col("tall"), w, h, F.col("area") / (w * h), _s())
    cx, cy = (F.col("x0") + F.col("x1")) * 0.5, (F.col("y0") + F.col("y1")) * 0.5
    told = told.withColumn("k", kind).where("k.kind is not null")
    told = told.where((cx >= F.col("scan_x0") - 0.8 * _s()) & (cx <= F.col("staff_x1") + 0.3 * _s()) & (pitch_distance(cy, F.col("top"), _s()) <= 1.35 * _s()))
    told = _without_text(told, text).select(*KEYS, "seq", *BOX, "k.kind", "k.score", (F.col("area") / (w * h)).alias("density"))
    return boxes.suppress(told, KEYS, [*BOX, "kind", "density"], boxes.boxes_conflict(4))


# ------------------------------------------------------------------------ bars
def bar_columns(mask: DataFrame, staves: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, staff, x, start, end): columns of a staff whose longest run, over
    gaps of one pixel, is nearly as long as the staff is high."""
    where = regions(staves, pages, F.col("scan_x0") - 0.8 * _s(), F.col("x1") + 0.4 * _s(), 0.35)
    where = where.select(*KEYS, "space", "rx0", "ry0", "rx1", "ry1")
    held = mask.join(where, "page_id").where("y >= ry0 and y < ry1 and x >= rx0 and x < rx1")
    runs = islands(held.select(*KEYS, "space", "x", "y"), [*KEYS, "space", "x"], "y", P.bar_gap_px + 1)
    length = F.col("end") - F.col("start") + 1
    best = runs.where(length >= half_even(P.bar_least * _s())).groupBy(*KEYS, "x").agg(F.max_by(F.struct("start", "end"), F.struct(length, -F.col("start"))).alias("r"))
    return best.select(*KEYS, "x", "r.start", "r.end")


def find_bars(mask: DataFrame, staves: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, staff, x, y0, y1, kind, score): such columns within two of each
    other are one bar, at their middle; a bar stays if another near staff has it
    too, and all stay on a page where none does or that has one staff."""
    columns = bar_columns(mask, staves, pages)
    middle = half_even(F.median("x")).alias("bar_x")
    found = islands(columns.withColumnRenamed("start", "top_y").withColumnRenamed("end", "end_y"), KEYS, "x", 2, middle, F.min("top_y").alias("y0"), F.max("end_y").alias("y1"))
    where = regions(staves, pages, F.col("scan_x0"), F.col("x1"), 0.35).select(*KEYS, "top", "space", F.col("x0").alias("staff_x0"), (F.col("ry1") - F.col("ry0")).alias("high"))
    length = F.col("y1") - F.col("y0") + 1
    kind = F.when(F.abs(F.col("bar_x") - F.col("staff_x0")) <= 1.2 * _s(), "system_start").otherwise("barline")
    bars = found.join(where, KEYS).where(length >= half_even(P.bar_least * _s()))
    bars = cut(bars.select(*KEYS, F.col("bar_x").alias("x"), "y0", "y1", kind.alias("kind"), (length / F.greatest(F.lit(1.0), F.col("high"))).alias("score"), "top", "space"))
    a, b = bars.alias("a"), bars.select("page_id", "staff", "x", "top").alias("b")
    again = (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.staff") != F.col("b.staff")) & (F.abs(F.col("a.x") - F.col("b.x")) <= F.greatest(F.lit(P.bar_match_px), P.bar_match * F.col("a.space")))
    again = again & (F.abs(F.col("a.top") - F.col("b.top")) <= P.bar_reach * F.col("a.space"))
    seen = a.join(b, again, "left_semi").select(*KEYS, "x", F.lit(1).alias("seen"))
    alone = staves.groupBy("page_id").agg((F.count("*") < 2).alias("alone"))
    marked = bars.join(seen, [*KEYS, "x"], "left").join(alone, "page_id").withColumn("seen", F.coalesce(F.col("seen"), (F.col("kind") == "system_start").cast("int"), F.lit(0)))
    any_seen = F.max("seen").over(Window.partitionBy("page_id"))
    return marked.withColumn("any_seen", any_seen).where("alone or seen = 1 or any_seen = 0").select(*KEYS, "x", "y0", "y1", "kind", "score")


# ------------------------------------------------------------- stems and ledgers
def find_stems(cleaned: DataFrame, notes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, note, staff, x, y0, y1, direction, length, score) for notes (page_id,
    note, staff, x, y, space): of the columns right of a head upwards and left of
    it downwards the longest run; ties: up, then the smaller x."""
    most, back = half_even(P.stem_most * _s()), half_even(0.65 * _s())
    row = half_even(F.col("y"))
    up = F.struct(F.lit("up").alias("direction"), half_even(F.col("x") + 0.25 * _s()).alias("a"), half_even(F.col("x") + 1.10 * _s()).alias("b"), (row - most).alias("lo"), (row + back).alias("hi"))
    down = F.struct(F.lit("down").alias("direction"), half_even(F.col("x") - 1.10 * _s()).alias("a"), half_even(F.col("x") - 0.25 * _s()).alias("b"), (row - back).alias("lo"), (row + most).alias("hi"))
    ways = notes.select("page_id", "note", "staff", "space", F.explode(F.array(up, down)).alias("w"))
    ways = ways.join(pages, "page_id").select("page_id", "note", "staff", "space", "w.direction", F.explode(F.sequence("w.a", "w.b")).alias("x"), F.greatest(F.lit(0), F.col("w.lo")).alias("lo"), F.least("height", F.col("w.hi")).alias("hi"))
    held = ways.join(cleaned, ["page_id", "x"]).where("y >= lo and y < hi")
    ids = ["page_id", "note", "staff", "space", "direction", "x"]
    runs = islands(held.select(*ids, "y"), ids, "y", P.stem_gap_px + 1).withColumn("length", F.col("end") - F.col("start") + 1)
    rank = F.struct("length", (F.col("direction") == "up").cast("int"), -F.col("x"), -F.col("start"))
    best = runs.where(F.col("length") >= half_even(P.stem_least * _s())).groupBy("page_id", "note", "staff", "space").agg(F.max_by(F.struct("x", F.col("start").alias("y0"), F.col("end").alias("y1"), "direction", "length"), rank).alias("s"))
    return best.select("page_id", "note", "staff", "s.*", (F.col("s.length") / F.greatest(F.lit(1.0), most)).alias("score"), "space")


def find_ledgers(mask: DataFrame, notes: DataFrame, staves: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, staff, note, side, line_number, x0, y0, x1, y1, score): at each ledger
    position between a note and its staff the longest run that crosses the note."""
    n = notes.join(staves.select(*KEYS, "top", "bottom"), KEYS).join(pages, "page_id").withColumnRenamed("x", "cx")
    side = F.when(F.col("y") < F.col("top") - 0.45 * _s(), "above").when(F.col("y") > F.col("bottom") + 0.45 * _s(), "below")
    n = n.withColumn("side", side).where("side is not null").withColumn("far", F.when(F.col("side") == "above", F.col("top") - F.col("y")).otherwise(F.col("y") - F.col("bottom")))
    n = n.withColumn("line_number", F.explode(F.sequence(F.lit(1), (F.ceil(F.col("far") / _s()) + 1).cast("int"))))
    n = n.withColumn("line_y", F.when(F.col("side") == "above", F.col("top") - F.col("line_number") * _s()).otherwise(F.col("bottom") + F.col("line_number") * _s()))
    n = n.where(F.abs(F.col("line_y") - F.col("y")) <= F.greatest(1.25 * _s(), F.col("far") + _s()))
    row, half = half_even(F.col("line_y")), F.greatest(F.lit(1), half_even(0.14 * _s()))
    n = n.where((row >= 0) & (row < F.col("height")))
    ids = ["page_id", "staff", "note", "side", "line_number", "cx", "space", "top_y", "end_y"]
    n = n.withColumn("top_y", F.greatest(F.lit(0), row - half)).withColumn("end_y", F.least(F.col("height"), row + half + 1))
    n = n.withColumn("a", F.greatest(F.lit(0), half_even(F.col("cx") - 1.45 * _s()))).withColumn("b", F.least("width", half_even(F.col("cx") + 1.45 * _s())))
    rows = n.select(*ids, "a", "b", F.explode(F.sequence(F.col("top_y"), F.col("end_y") - 1)).alias("y"))
    held = rows.join(mask, ["page_id", "y"]).where("x >= a and x < b").select(*ids, "x").distinct()
    found = islands(held, ids, "x").where((F.col("start") <= F.col("cx") + 0.35 * _s()) & (F.col("end") >= F.col("cx") - 0.35 * _s())).withColumn("length", F.col("end") - F.col("start") + 1)
    best = found.groupBy(*ids).agg(F.max_by(F.struct(F.col("start").alias("x0"), F.col("end").alias("x1"), "length"), F.struct("length", -F.col("start"))).alias("b"))
    best = best.where(F.col("b.length").between(0.75 * _s(), 3.0 * _s()))
    order = Window.partitionBy("page_id").orderBy("note", "line_number")
    lines = best.select("page_id", "staff", "note", "side", "line_number", "b.x0", F.col("top_y").alias("y0"), "b.x1", F.col("end_y").alias("y1"), F.least(F.lit(1.0), F.col("b.length") / F.greatest(F.lit(1.0), 1.8 * _s())).alias("score"))
    lines = lines.withColumn("seq", F.row_number().over(order).cast("long"))
    return boxes.suppress(lines, ["page_id", "staff", "side"], ["note", "line_number", *BOX], boxes.centers_conflict(8, 4)).drop("seq")


# ----------------------------------------------------------------------- beams
def corridors(ink: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, line, hit_ratio, density) along lines (page_id, line, x0, y0, x1, y1,
    half, height, width): the share of columns with ink within ``half`` rows, and
    of pixels; parts beyond the page do not count."""
    dx = F.col("x1") - F.col("x0")
    margin = F.greatest(F.lit(2), half_even(dx * 0.08))
    low, high = F.greatest(F.lit(0), F.col("x0") + margin), F.least(F.col("width") - 1, F.col("x1") - margin)
    along = lines.withColumn("lo", low).withColumn("hi", high).where(F.col("hi") - F.col("lo") + 1 >= F.greatest(F.lit(6.0), dx * 0.45))
    along = along.withColumn("x", F.explode(F.sequence("lo", "hi")))
    center = half_even(F.col("y0") + (F.col("y1") - F.col("y0")) * ((F.col("x") - F.col("x0")) / F.greatest(F.lit(1), dx)))
    stripe = along.select("page_id", "line", "x", F.explode(F.sequence(center - F.col("half"), center + F.col("half"))).alias("y"), "height").where("y >= 0 and y < height")
    counts = stripe.join(ink.withColumn("_ink", F.lit(1)), ["page_id", "y", "x"], "left").groupBy("page_id", "line", "x").agg(F.count("_ink").alias("black"), F.count("*").alias("total"))
    return counts.groupBy("page_id", "line").agg((F.sum((F.col("black") > 0).cast("int")) / F.count("*")).alias("hit_ratio"), (F.sum("black") / F.sum("total")).alias("density"))


def find_links(cleaned: DataFrame, stems: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, staff, direction, left, right, gap, x0, y0, x1, y1, score, hit_ratio,
    density) between the free ends of stems (page_id, stem, staff, direction, x, y0,
    y1, length, space): each end's best link to the next four, moved up or down by
    part of a space where the straight line has too little ink; of links that
    share both ends only the best.  ``gap`` counts the stems of all lengths between."""
    keys = ["page_id", "staff", "direction", "space"]
    end = stems.withColumn("seq", F.col("stem")).withColumn("y", marks.stem_end(F.col("direction"), F.col("y0"), F.col("y1")))
    rank = end.select(*keys, "seq", F.row_number().over(Window.partitionBy(*keys).orderBy("x", "seq")).alias("rank"))
    pairs = marks.stem_pairs(end.where(F.col("length") >= 1.85 * _s()).select(*keys, "seq", "x", "y"), keys, 1.10 * _s(), 7.50 * _s(), 2.60 * _s(), 0.85)
    pairs = cut(pairs.withColumnRenamed("gap", "ahead"))
    half = F.greatest(F.lit(2), half_even(0.22 * _s()))
    shifts = F.array(*[F.struct(F.lit(k).alias("k"), (_s() * s).alias("shift")) for k, s in enumerate((0.0, -0.38, 0.38, -0.72, 0.72))])
    moved = pairs.withColumn("s", F.explode(shifts)).join(pages, "page_id")
    moved = moved.withColumn("y0", half_even(F.col("y0") + F.col("s.shift"))).withColumn("y1", half_even(F.col("y1") + F.col("s.shift"))).withColumn("half", half)
    line = F.struct("staff", "direction", "left", "right", F.col("s.k").alias("k"))
    moved = moved.withColumn("line", line)
    felt = moved.join(corridors(cleaned, moved), ["page_id", "line"], "left").fillna(0.0, ["hit_ratio", "density"])
    tried = F.struct(F.col("s.k").alias("k"), "y0", "y1", "hit_ratio", "density")
    every = felt.groupBy(*keys, "left", "right", "ahead", "x0", "x1").agg(F.array_sort(F.collect_list(tried)).alias("t"))
    straight = F.get("t", F.lit(0))
    sums = lambda t: t["hit_ratio"] + t["density"]
    best = F.aggregate("t", straight, lambda b, t: F.when(sums(t) > sums(b), t).otherwise(b))
    enough = (straight["hit_ratio"] >= P.beam_hit) & (straight["density"] >= P.beam_density)
    found = every.withColumn("b", F.when(enough, straight).otherwise(best)).where((F.col("b.hit_ratio") >= P.beam_hit) & (F.col("b.density") >= P.beam_density))
    found = found.withColumn("score", F.least(F.lit(1.0), 0.72 * F.col("b.hit_ratio") + 0.55 * F.col("b.density")))
    first = Window.partitionBy(*keys, "left").orderBy(F.col("score").desc(), "ahead")
    found = found.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    order = Window.partitionBy(*keys).orderBy("x0", "left")
    found = found.select(*keys, "left", "right", "x0", "b.y0", "x1", "b.y1", "score", "b.hit_ratio", "b.density", F.row_number().over(order).cast("long").alias("seq"))
    reach = lambda a, b: (F.abs(a["x0"] - b["x0"]) <= 0.45 * a["space"]) & (F.abs(a["x1"] - b["x1"]) <= 0.45 * a["space"])
    kept = boxes.suppress(found, ["page_id", "staff", "direction"], ["space", "left", "right", *BOX, "hit_ratio", "density"], reach)
    for side in ("left", "right"):
        kept = kept.join(rank.select(*keys, F.col("seq").alias(side), F.col("rank").alias(f"_{side}")), [*keys, side])
    return kept.withColumn("gap", F.col("_right") - F.col("_left")).drop("_left", "_right", "seq")


# ----------------------------------------------------------- secondary symbols
def symbol_flags(parts: DataFrame, bars: DataFrame, groups: DataFrame, stems: DataFrame, notes: DataFrame) -> DataFrame:
    """Parts (page_id, staff, seq, x0 .. y1, area, top, space) with what stands by
    them: near_bar, near_group, near_stem, close_note.  Groups are boxes; notes
    are points; each is joined by staff and strip of columns."""
    s = F.col("a.space")
    out = flagged(parts, spans(bars, "x", "x"), lambda a, b: marks.near_bar(a, b, 0.45 * s), 0.45 * _s(), "near_bar")
    out = flagged(out, spans(groups), lambda a, b: marks.near_group(a, b, 0.20 * s), 0.20 * _s() + 1, "near_group")
    out = flagged(out, spans(stems, "x", "x"), lambda a, b: marks.near_stem(a, b, s), 0.75 * _s(), "near_stem")
    inside = lambda a, b: boxes.holds_point(a, b("x"), b("y"), 0.35 * s)
    return flagged(out, spans(notes, "x", "x"), inside, 0.35 * _s(), "close_note")


def symbol_kinds(parts: DataFrame) -> DataFrame:
    """Flagged parts that no bar, beam group, stem or notehead explains, with
    ``density`` and the struct ``k`` of their kind (null if none) and score."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    cy, density = (F.col("y0") + F.col("y1")) * 0.5, F.col("area") / (w * h)
    free = ~F.col("near_bar") & ~F.col("near_group") & ~(F.col("near_stem") & (w <= 2.2 * _s()))
    free = free & ~marks.notehead_like(w, h, density, pitch_distance(cy, F.col("top"), _s()), F.col("near_stem"), _s())
    sized = parts.where((F.col("area") >= F.greatest(F.lit(4), (0.08 * _s() * _s()).cast("int"))) & free)
    return sized.withColumn("density", density).withColumn("k", marks.symbol_kind(w, h, density, F.col("area"), cy, F.col("close_note"), F.col("top"), _s()))


def find_symbols(pruned: DataFrame, staves: DataFrame, pages: DataFrame, bars: DataFrame, groups: DataFrame, stems: DataFrame, notes: DataFrame) -> DataFrame:
    """(page_id, staff, family, x0 .. y1, kind, score, density): rests, beams and slurs
    or ties, of each those that do not meet a better one."""
    where = regions(staves, pages, F.col("scan_x0"), F.col("x1") + _s(), 3.0)
    parts = cut(region_parts(ink_runs(pruned), where)).join(staves.select(*KEYS, "top", "space"), KEYS)
    told = symbol_kinds(symbol_flags(parts, bars, groups, stems, notes)).where("k.kind is not null")
    family = F.when(F.col("k.kind").endswith("_rest"), "rests").when(F.col("k.kind") == "beam_candidate", "beams").otherwise("slurs_or_ties")
    told = told.select(*KEYS, family.alias("family"), "seq", *BOX, "k.kind", "k.score", "density")
    return boxes.suppress(told, [*KEYS, "family"], [*BOX, "kind", "density"], boxes.boxes_conflict(3)).drop("seq")
