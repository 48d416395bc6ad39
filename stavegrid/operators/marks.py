"""Relations between marks: text, stems, beams, bars and the anti-filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavegrid.operators.durable import cut
from stavegrid.operators.runs import islands
from stavegrid.params import DEFAULTS as P

Box = Callable[[str], Column]


def of(alias: str) -> Box:
    return lambda name: F.col(f"{alias}.{name}")


# ------------------------------------------------------------------------ text
def is_text_part(b: Box, space: Column | float) -> Column:
    w, h = b("x1") - b("x0"), b("y1") - b("y0")
    density = b("area") / F.greatest(F.lit(1), w * h)
    sized = w.between(0.10 * space, 1.85 * space) & h.between(0.25 * space, 1.75 * space)
    return (w > 0) & (h > 0) & sized & density.between(0.08, 0.82) & ~((w <= 0.22 * space) & (h >= 1.45 * space))


def in_text_cluster(boxes: DataFrame, keys: list[str], space: Column | float) -> DataFrame:
    """(keys, seq) of text parts with two others beside them on the line.  Parts
    are joined by strips of rows as high as parts on a line may differ."""
    space = space if isinstance(space, Column) else F.lit(space)
    parts = boxes.where(is_text_part(F.col, space)).withColumn("_s", space).withColumn("_cy", (F.col("y0") + F.col("y1")) * 0.5)
    parts = parts.select(*keys, "seq", "x0", "x1", "_s", "_cy", F.floor(F.col("_cy") / (0.68 * F.col("_s"))).alias("_cell"))
    parts = cut(parts)  # else the join's sides infer the test of parts from each other, too large to be compiled
    a, b = parts.alias("a"), parts.withColumn("_cell", F.explode(F.array(F.col("_cell") - 1, F.col("_cell"), F.col("_cell") + 1))).alias("b")
    same = F.col("a._cell") == F.col("b._cell")
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    level = F.abs(F.col("a._cy") - F.col("b._cy")) <= 0.68 * F.col("a._s")
    gap = F.greatest(F.lit(0), F.col("b.x0") - F.col("a.x1"), F.col("a.x0") - F.col("b.x1"))
    pairs = a.join(b, same & (F.col("a.seq") != F.col("b.seq")) & level & (gap <= 1.75 * F.col("a._s")))
    return pairs.groupBy(*[F.col(f"a.{k}") for k in keys], F.col("a.seq")).agg(F.count("*").alias("n")).where("n >= 2").drop("n")


def phrases(boxes: DataFrame, keys: list[str], space: float) -> DataFrame:
    """(keys, phrase, x0, y0, x1, y1, n): boxes of a row from left to right, cut
    where the gap to the box before is wide or the two are at different heights."""
    order = Window.partitionBy(*keys).orderBy("x0", "seq")
    gap = F.col("x0") - F.lag("x1").over(order)
    overlap = F.least(F.col("y1"), F.lag("y1").over(order)) - F.greatest(F.col("y0"), F.lag("y0").over(order))
    joined = F.coalesce((gap <= 1.35 * space) & (overlap >= -0.25 * space), F.lit(False))
    parted = boxes.withColumn("_new", F.when(joined, 0).otherwise(1))
    parted = parted.withColumn("phrase", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return parted.groupBy(*keys, "phrase").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


def phrase_score(n: Column, width: Column, space: Column | float, match: float = 0.0) -> Column:
    compact = F.least(F.lit(1.0), width / F.greatest(F.lit(1.0), F.lit(5.0) * space))
    return F.least(F.lit(1.0), F.greatest(F.lit(match), 0.34 + 0.08 * F.least(F.lit(5), n) + 0.20 * compact))


def accidental_kind(rows: Column, columns: Column, tall: Column, w: Column, h: Column, density: Column, space: float) -> Column:
    """struct(kind, score) from a crop's projection islands; kind is null if neither fits."""
    sized = w.between(0.35 * space, 2.15 * space) & h.between(0.85 * space, 3.65 * space) & density.between(0.08, 0.82) & (h >= 1.65 * space)
    sharp = sized & w.between(0.50 * space, 1.55 * space) & (rows >= 3) & (tall >= 4) & ((columns >= 1) | (density >= 0.32))
    natural = sized & (rows >= 2) & (columns >= 2) & (tall >= 3) & (density >= 0.18)
    score = F.when(sharp, F.least(F.lit(1.0), 0.45 + 0.10 * rows + 0.10 * columns + 0.25 * density)).when(natural, F.least(F.lit(1.0), 0.34 + 0.09 * rows + 0.12 * columns + 0.22 * density))
    return F.struct(F.when(sharp, "sharp").when(natural, "natural").alias("kind"), F.coalesce(score, F.lit(0.0)).alias("score"))


# ----------------------------------------------------------------------- stems
def stem_end(direction: Column, y0: Column, y1: Column) -> Column:
    """The free end: the top of a stem that points up, the bottom of others."""
    return F.when(direction == "up", y0).otherwise(y1)


def best_stems(runs: DataFrame, least: float) -> DataFrame:
    """(note, ...): of the column runs around a note (note, direction, x, start,
    end, length) the longest; ties: up before down, then the leftmost."""
    rank = F.struct("length", F.when(F.col("direction") == "up", 1).otherwise(0), -F.col("x"))
    found = runs.where(F.col("length") >= least).groupBy("note").agg(F.max_by(F.struct("direction", "x", "start", "end", "length"), rank).alias("s"))
    return found.select("note", "s.*")


def confirmed_bars(bars: DataFrame, space: float) -> DataFrame:
    """Bars (page_id, staff, seq, x, top) that another near staff of the page
    repeats; all bars of a page where none is repeated, or of one staff."""
    near = max(P.bar_match_px, P.bar_match * space)
    cell = F.floor(F.col("x") / near)  # bars that near are in the same cell or in the next
    a = bars.withColumn("_cell", cell).alias("a")
    b = bars.select("page_id", "staff", "x", "top", F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell")).alias("b")
    again = (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a._cell") == F.col("b._cell")) & (F.col("a.staff") != F.col("b.staff"))
    again = again & (F.abs(F.col("a.x") - F.col("b.x")) <= near) & (F.abs(F.col("a.top") - F.col("b.top")) <= P.bar_reach * space)
    seen = a.join(b, again, "left_semi").select("page_id", "staff", "seq").withColumn("_seen", F.lit(1))
    flagged = bars.join(seen, ["page_id", "staff", "seq"], "left")
    any_seen = F.max("_seen").over(Window.partitionBy("page_id"))
    return flagged.withColumn("_any", any_seen).where("_any is null or _seen = 1").drop("_seen", "_any")


# ----------------------------------------------------------------------- beams
def stem_pairs(stems: DataFrame, keys: list[str], least_dx: float, most_dx: float, most_dy: float, most_slope: float, ahead: int = P.beam_ahead) -> DataFrame:
    """(keys, left, right, dx, dy, gap, x0, y0, x1, y1): each stem end (seq, x, y)
    with those of the next ``ahead`` that are neither too near nor too far; ``gap``
    is how many further.  The look-ahead is an equi-join on rank, not a range join."""
    ranked = stems.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("x", "seq")))
    left = ranked.select(*keys, F.col("seq").alias("left"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("rn").alias("at"), F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + ahead)).alias("rn"))
    right = ranked.select(*keys, F.col("seq").alias("right"), F.col("x").alias("rx"), F.col("y").alias("ry"), "rn")
    both = left.join(right, [*keys, "rn"]).withColumn("dx", F.col("rx") - F.col("lx")).withColumn("dy", F.col("ry") - F.col("ly"))
    fits = F.col("dx").between(least_dx, most_dx) & (F.abs("dy") <= most_dy) & (F.abs(F.col("dy") / F.greatest(F.lit(1), F.col("dx"))) <= most_slope)
    ends = [F.col(a).alias(b) for a, b in (("lx", "x0"), ("ly", "y0"), ("rx", "x1"), ("ry", "y1"))]
    return both.where(fits).select(*keys, "left", "right", "dx", "dy", (F.col("rn") - F.col("at")).alias("gap"), *ends)


def corridor(ink: DataFrame, lines: DataFrame, half_width: int) -> DataFrame:
    """(page_id, line, hit_ratio, density): how many columns along a line (page_id,
    line, x0, y0, x1, y1) have ink within half_width rows, and how much."""
    dx = F.col("x1") - F.col("x0")
    margin = F.greatest(F.lit(2), F.rint(dx * 0.08).cast("int"))
    along = lines.withColumn("_m", margin).where(dx - 2 * F.col("_m") + 1 >= F.greatest(F.lit(6.0), dx * 0.45))
    along = along.withColumn("x", F.explode(F.sequence(F.col("x0") + F.col("_m"), F.col("x1") - F.col("_m"))))
    center = F.rint(F.col("y0") + (F.col("y1") - F.col("y0")) * ((F.col("x") - F.col("x0")) / F.greatest(F.lit(1), dx))).cast("int")
    stripe = along.select("page_id", "line", "x", F.explode(F.sequence(center - half_width, center + half_width)).alias("y"))
    counts = stripe.join(ink.withColumn("_ink", F.lit(1)), ["page_id", "y", "x"], "left").groupBy("page_id", "line", "x").agg(F.count("_ink").alias("black"), F.count("*").alias("total"))
    return counts.groupBy("page_id", "line").agg(F.avg((F.col("black") > 0).cast("double")).alias("hit_ratio"), (F.sum("black") / F.sum("total")).alias("density"))


# ---------------------------------------------------------------- anti-filters
def near_bar(b: Box, bar: Box, margin: float) -> Column:
    return F.abs(bar("x") - (b("x0") + b("x1")) * 0.5) <= margin


def near_group(b: Box, g: Box, margin: float) -> Column:
    x = F.least(b("x1"), g("x1") + margin) >= F.greatest(b("x0"), g("x0") - margin)
    return x & (F.least(b("y1"), g("y1") + margin) >= F.greatest(b("y0"), g("y0") - margin))


def near_stem(b: Box, s: Box, space: float) -> Column:
    cx, cy = (b("x0") + b("x1")) * 0.5, (b("y0") + b("y1")) * 0.5
    close = s("x").between(b("x0") - 0.75 * space, b("x1") + 0.75 * space) & (F.least(s("y1"), b("y1") + 0.8 * space) >= F.greatest(s("y0"), b("y0") - 0.8 * space))
    return close | ((F.abs(s("x") - cx) <= 0.45 * space) & cy.between(s("y0") - space, s("y1") + space))


def notehead_like(w: Column, h: Column, density: Column, pitch: Column, by_stem: Column, space: float) -> Column:
    sized = w.between(0.55 * space, 1.75 * space) & h.between(0.38 * space, 1.10 * space) & (pitch <= 0.24 * space)
    round_ = (w / F.greatest(F.lit(1), h)).between(0.75, 2.20) & (density >= 0.42)
    return sized & (round_ | by_stem)


def symbol_kind(w: Column, h: Column, density: Column, area: Column, cy: Column, close_note: Column, top: Column, space: float) -> Column:
    """struct(kind, score) of a component that passed the filters: the first of
    whole or half rest, quarter or eighth rest, beam, slur that fits."""
    body = ~close_note & cy.between(top - 1.15 * space, top + 5.15 * space)
    middle = cy.between(top + 0.65 * space, top + 3.35 * space)
    long_rest = body & w.between(0.55 * space, 2.2 * space) & h.between(0.14 * space, 0.52 * space) & (w / F.greatest(F.lit(1), h) >= 2.05) & (density >= 0.35) & middle
    short_rest = body & w.between(0.25 * space, 1.45 * space) & h.between(0.9 * space, 3.2 * space) & (density <= 0.62)
    beam = (w >= 1.45 * space) & (h <= 0.95 * space) & (density >= 0.38)
    slur = (w >= 1.8 * space) & h.between(0.18 * space, 1.7 * space) & density.between(0.035, 0.36)
    kind = F.when(long_rest, "whole_or_half_rest").when(short_rest, "quarter_or_eighth_rest").when(beam, "beam_candidate")
    kind = kind.when(slur & (w <= 6.5 * space), "tie_or_slur_candidate").when(slur, "slur_candidate")
    score = F.when(long_rest, density).when(short_rest, (area / (space * space)) / F.greatest(F.lit(1.0), h / space))
    score = score.when(beam, F.least(F.lit(1.0), w / F.greatest(F.lit(1.0), F.lit(4.0) * space) * density)).when(slur, F.least(F.lit(1.0), w / F.greatest(F.lit(1.0), F.lit(5.0) * space) * (0.45 - density)))
    return F.struct(kind.alias("kind"), F.coalesce(score, F.lit(0.0)).alias("score"))


def ledger_runs(runs: DataFrame, notes: DataFrame, space: float) -> DataFrame:
    """(page_id, note, side, line_number, x0, x1): for notes (page_id, note, x, y, top,
    bottom) beyond the staff, the longest ink run that crosses each ledger
    position between it and the staff.  Runs: (page_id, y, x0, x1), ends included."""
    side = F.when(F.col("y") < F.col("top") - 0.45 * space, "above").when(F.col("y") > F.col("bottom") + 0.45 * space, "below")
    away = notes.withColumn("side", side).where("side is not null").withColumn("far", F.when(F.col("side") == "above", F.col("top") - F.col("y")).otherwise(F.col("y") - F.col("bottom")))
    away = away.withColumn("line_number", F.explode(F.sequence(F.lit(1), (F.ceil(F.col("far") / space) + 1).cast("int"))))
    line = F.when(F.col("side") == "above", F.col("top") - F.col("line_number") * space).otherwise(F.col("bottom") + F.col("line_number") * space)
    away = away.withColumn("line_y", line).where(F.abs(F.col("line_y") - F.col("y")) <= F.greatest(F.lit(1.25 * space), F.col("far") + space)).withColumn("row", F.rint("line_y").cast("int"))
    n, r = away.alias("n"), runs.alias("r")
    window = (F.col("n.page_id") == F.col("r.page_id")) & F.col("r.y").between(F.col("n.row") - 1, F.col("n.row") + 1)
    first, last = F.rint(F.col("n.x") - 1.45 * space).cast("int"), F.rint(F.col("n.x") + 1.45 * space).cast("int") - 1
    near = window & (F.col("r.x0") <= last) & (F.col("r.x1") >= first)
    columns = n.join(r, near).select("n.page_id", "n.note", "n.side", "n.line_number", F.col("n.x").alias("cx"), F.explode(F.sequence(F.greatest(F.col("r.x0"), first), F.least(F.col("r.x1"), last))).alias("x")).distinct()
    found = islands(columns, ["page_id", "note", "side", "line_number", "cx"], "x").where((F.col("start") <= F.col("cx") + 0.35 * space) & (F.col("end") >= F.col("cx") - 0.35 * space))
    length = F.col("end") - F.col("start") + 1
    best = found.groupBy("page_id", "note", "side", "line_number").agg(F.max_by(F.struct(F.col("start").alias("x0"), F.col("end").alias("x1"), length.alias("length")), F.struct(length, -F.col("start"))).alias("b"))
    return best.select("page_id", "note", "side", "line_number", "b.*").where(F.col("length").between(0.75 * space, 3.0 * space))
