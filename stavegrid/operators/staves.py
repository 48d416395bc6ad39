"""Staff geometry from line candidates, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavegrid.operators.raster import row_projection, strong_rows
from stavegrid.operators.runs import islands
from stavegrid.params import DEFAULTS as P


def line_candidates(ink: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(page_id, y, thickness, x0, x1, strength): bands of strong rows whose ink
    columns hold one long run.  y is the ink-weighted mean row."""
    projection = row_projection(ink, rows)
    limit = F.greatest(F.lit(width * P.line_width_share), F.col("strong") * P.line_peak_share)
    strong = projection.join(strong_rows(projection), "page_id").where(F.col("n") > limit)
    center = F.sum(F.col("y") * F.col("n")) / F.greatest(F.lit(1), F.sum("n"))
    bands = islands(strong.select("page_id", "y", F.col("n").alias("ink")).withColumnRenamed("ink", "n"), ["page_id"], "y", 1, center.alias("center"), F.max("n").alias("strength"))
    bands = bands.select("page_id", F.col("start").alias("top"), F.col("end").alias("bottom"), "center", "strength")
    columns = ink.alias("i").join(bands.alias("b"), (F.col("i.page_id") == F.col("b.page_id")) & F.col("i.y").between(F.col("b.top"), F.col("b.bottom")))
    columns = columns.select("b.page_id", "b.top", "i.x").distinct()
    runs = islands(columns, ["page_id", "top"], "x")
    length = F.col("end") - F.col("start") + 1
    best = runs.groupBy("page_id", "top").agg(F.max_by(F.struct("start", "end"), F.struct(length, -F.col("start"))).alias("r")).select("page_id", "top", F.col("r.start").alias("x0"), F.col("r.end").alias("x1"))
    found = bands.join(best, ["page_id", "top"]).where((F.col("x1") > F.col("x0")) & (F.col("x1") - F.col("x0") + 1 >= width * P.line_run_share))
    return found.select("page_id", F.col("center").alias("y"), (F.col("bottom") - F.col("top") + 1).alias("thickness"), "x0", "x1", "strength")


def staff_space(lines: DataFrame, key: str = "page_id", y: str = "y") -> DataFrame:
    """(key, space): the median of the line gaps near their most common whole
    value, lowest of equals; null where no gap is in range."""
    gaps = lines.select(key, (F.lead(y).over(Window.partitionBy(key).orderBy(y)) - F.col(y)).alias("gap"))
    useful = gaps.where(F.col("gap").between(P.space_low_px, P.space_high_px))
    counts = useful.groupBy(key, F.rint("gap").cast("int").alias("v")).agg(F.count("*").alias("n"))
    mode = counts.groupBy(key).agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("mode"))
    near = useful.join(mode, key).groupBy(key).agg(F.coalesce(F.median(F.when(F.abs(F.col("gap") - F.col("mode")) <= P.space_near_px, F.col("gap"))), F.median("gap")).alias("space"))
    return lines.select(key).distinct().join(near, key, "left")


def group_staves(lines: DataFrame, key: str = "page_id", y: str = "y", space: str = "space", tolerance_px: float = P.staff_tolerance_px) -> DataFrame:
    """(key, staff, top, bottom): five lines in a row whose four gaps all are
    about a space; taken from the top, and a line serves one staff.

    Which line starts five good gaps is a window; which of the overlapping
    starts are taken is an ordered fold over a page's few lines.
    """
    order = Window.partitionBy(key).orderBy(y)
    tolerance = F.greatest(F.lit(tolerance_px), F.col(space) * P.staff_tolerance)
    good = [F.abs(F.lead(y, k + 1).over(order) - (F.lead(y, k).over(order) if k else F.col(y)) - F.col(space)) <= tolerance for k in range(4)]
    starts = lines.select(key, (F.row_number().over(order) - 1).alias("at"), F.col(y).alias("top"), F.lead(y, 4).over(order).alias("bottom"), (good[0] & good[1] & good[2] & good[3]).alias("fits")).where("fits")
    listed = starts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "top", "bottom"))).alias("s"))
    taken = F.aggregate("s", F.slice("s", 1, 0), lambda kept, s: F.when((F.size(kept) == 0) | (s["at"] >= F.element_at(kept, -1)["at"] + 5), F.concat(kept, F.array(s))).otherwise(kept))
    return listed.select(key, F.posexplode(taken).alias("staff", "s")).select(key, "staff", "s.top", "s.bottom")


def pitch_rows(staves: DataFrame, top: str = "top", space: str = "space") -> DataFrame:
    """A row for each half-space step from ten above the top line to eighteen below."""
    steps = staves.withColumn("pitch_step", F.explode(F.sequence(F.lit(P.pitch_first), F.lit(P.pitch_last))))
    return steps.withColumn("pitch_y", F.col(top) + F.col("pitch_step") * F.col(space) / 2)


def pitch_distance(y: Column, top: Column, space: Column) -> Column:
    """Distance to the nearest pitch row."""
    return F.array_min(F.transform(F.sequence(F.lit(P.pitch_first), F.lit(P.pitch_last)), lambda k: F.abs(y - (top + k * space / 2))))


def clef_boxes(boxes: DataFrame, staves: DataFrame) -> DataFrame:
    """(page_id, staff, x0, y0, x1, y1, clef_type, scan_x0): of the components at
    a staff's left end the largest big one, else the hull of the middling ones
    if that is large enough.  The type goes by the staff's parity; a staff
    without a clef keeps its scan start."""
    s, b = staves.alias("s"), boxes.alias("b")
    space = F.col("s.space")
    w, h = F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0")
    near = (F.col("s.page_id") == F.col("b.page_id")) & (F.col("s.staff") == F.col("b.staff")) & (F.col("b.x1") >= F.col("s.x0") - 0.05 * space)
    big = (h >= 2.0 * space) & (w >= 0.55 * space) & (F.col("b.area") >= 0.55 * space * space)
    middling = (F.col("b.area") >= 0.12 * space * space) & (w >= 0.18 * space) & (h >= 0.45 * space)
    box = F.struct("b.x0", "b.y0", "b.x1", "b.y1")
    hulls = s.join(b, near, "left").groupBy("s.page_id", "s.staff").agg(
        F.max_by(F.when(big, box), F.when(big, F.struct(F.col("b.area"), -F.col("b.seq")))).alias("big"),
        F.struct(*[f(F.when(middling, F.col(f"b.{c}"))).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]).alias("hull"),
        F.first("s.space").alias("space"),
        F.first("s.scan_x0").alias("scan"),
    )
    wide = (F.col("hull.x1") - F.col("hull.x0") >= 0.75 * F.col("space")) & (F.col("hull.y1") - F.col("hull.y0") >= 1.6 * F.col("space"))
    chosen = hulls.withColumn("c", F.coalesce("big", F.when(wide, F.col("hull"))))
    scan = F.when(F.col("c").isNull(), F.col("scan")).otherwise(F.greatest("scan", (F.col("c.x1") + 1.1 * F.col("space")).cast("int")))
    kind = F.when(F.col("staff") % 2 == 0, "treble").otherwise("bass")
    return chosen.select("page_id", "staff", "c.x0", "c.y0", "c.x1", "c.y1", kind.alias("clef_type"), scan.alias("scan_x0"))
