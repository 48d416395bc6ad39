"""Noteheads from integral tables: candidates, stencil densities, kinds, suppression.

Staves are rows (page_id, staff, top, bottom, space, x0, x1, scan_x0); pages are
rows (page_id, height, width).  An integral table has a row for each line between
pixel rows, whose array says how much ink lies above it and left of each column;
ink in any box is four of its numbers, in any span of a row too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavegrid.functions import half_even
from stavegrid.operators import boxes
from stavegrid.operators.durable import cut
from stavegrid.operators.runs import islands
from stavegrid.operators.staves import pitch_rows

#: Parts of a stencil in the order of the counts that :func:`stencil_counts` returns.
PARTS = ("outer", "inner", "surround", "left", "right", "top", "bottom", "core")
_KEYS = ["page_id", "staff", "pitch_step"]
#: Pitch rows whose candidates a task counts at once; their tables stay Arrow's, as they came.
ROWS_AT_ONCE = 128


# -------------------------------------------------------------------- stencils
def radii(staves: DataFrame) -> DataFrame:
    """(rx, ry) of the heads on these staves, each pair once."""
    return staves.select(*_radii()).distinct()


def _radii() -> list[Column]:
    rx, ry = half_even(F.col("space") * 0.78), half_even(F.col("space") * 0.50)
    return [F.greatest(F.lit(5), rx).alias("rx"), F.greatest(F.lit(4), ry).alias("ry")]


def stencil_spans(sizes: DataFrame) -> DataFrame:
    """(rx, ry, part, dy, x0, x1): row spans, ends included, of each part of the
    stencil around (0, 0).

    The outer ellipse fills the window; the surround is cut to the window; the
    ring is outer without inner, and left, right, top, bottom are its sectors.
    A staff space is 6 to 80 pixels, so there are at most a hundred pairs of
    radii, and their spans are broadcast.
    """
    cells = sizes.select("rx", "ry", F.explode(F.sequence(-F.col("ry"), F.col("ry"))).alias("dy"))
    cells = cells.select("*", F.explode(F.sequence(-F.col("rx"), F.col("rx"))).alias("dx"))

    def disc(a: float, b: float) -> Column:
        u, v = F.col("dx") / F.greatest(F.lit(1.0), F.col("rx") * a), F.col("dy") / F.greatest(F.lit(1.0), F.col("ry") * b)
        return u * u + v * v <= 1.0

    ring = disc(1.0, 1.0) & ~disc(0.50, 0.48)
    inside = {
        "outer": disc(1.0, 1.0), "inner": disc(0.50, 0.48), "surround": disc(1.35, 1.35) & ~disc(1.0, 1.0), "core": disc(0.34, 0.30),
        "left": ring & (F.col("dx") <= -0.18 * F.col("rx")), "right": ring & (F.col("dx") >= 0.18 * F.col("rx")),
        "top": ring & (F.col("dy") <= -0.15 * F.col("ry")), "bottom": ring & (F.col("dy") >= 0.15 * F.col("ry")),
    }
    named = F.filter(F.array(*[F.when(test, F.lit(part)) for part, test in inside.items()]), lambda p: p.isNotNull())
    parts = cells.select("rx", "ry", "dy", "dx", F.explode(named).alias("part"))
    return islands(parts, ["rx", "ry", "part", "dy"], "dx").select("rx", "ry", "part", "dy", F.col("start").alias("x0"), F.col("end").alias("x1"))


def stencil_areas(spans: DataFrame) -> DataFrame:
    """(rx, ry, part, area)."""
    return spans.groupBy("rx", "ry", "part").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("int").alias("area"))


# -------------------------------------------------------------- integral table
def integral_rows(ink: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, y, sums): for y = 0 .. height the ink above row y and left of
    column 0, 1, .., width.

    A running sum along each row, then one down each column: no task holds more
    than a row or a column of a page at once.
    """
    rows = pages.select("page_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    grid = rows.select("page_id", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    marked = grid.join(ink.select("page_id", "y", "x").withColumn("n", F.lit(1)), ["page_id", "y", "x"], "left")
    upto = Window.unboundedPreceding, Window.currentRow
    along = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("page_id", "y").orderBy("x").rowsBetween(*upto))
    down = F.sum("along").over(Window.partitionBy("page_id", "x").orderBy("y").rowsBetween(*upto))
    sums = marked.select("page_id", "y", "x", along.alias("along")).select("page_id", "y", "x", down.cast("int").alias("n"))
    listed = sums.groupBy("page_id", (F.col("y") + 1).alias("y")).agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("s"))
    listed = listed.select("page_id", "y", F.concat(F.array(F.lit(0)), F.col("s.n")).alias("sums"))
    return listed.unionByName(pages.select("page_id", F.lit(0).alias("y"), F.array_repeat(F.lit(0), (F.col("width") + 1).cast("int")).alias("sums")))


# ------------------------------------------------------------------ candidates
def note_rows(staves: DataFrame, pages: DataFrame) -> DataFrame:
    """Pitch rows with the columns [first, last) in which heads are looked for."""
    rows = pitch_rows(staves).join(pages, "page_id")
    first, last = F.greatest(F.lit(0), half_even(F.col("scan_x0"))), F.least(F.col("width"), half_even(F.col("x1") - F.col("space")))
    return rows.select("*", first.alias("first"), last.alias("last"), half_even(F.col("pitch_y")).alias("y"), *_radii())


def candidate_columns(rows: DataFrame, integral: DataFrame) -> DataFrame:
    """(page_id, staff, pitch_step, x): a grid along the pitch row, and the
    weighted middles of the ink runs of the band around it, with one to the left
    and one to the right of each; every column once.

    A band's ink by column is the difference of two rows of the integral table.
    """
    grid = rows.where("last > first").select(*_KEYS, F.explode(F.sequence(F.col("first"), F.col("last") - 1, F.greatest(F.lit(2), half_even(F.col("space") / 4.0)))).alias("x"))
    top = F.greatest(F.lit(0), half_even(F.col("pitch_y") - 0.72 * F.col("space")))
    bottom = F.least(F.col("height"), half_even(F.col("pitch_y") + 0.72 * F.col("space")) + 1)
    band = rows.select(*_KEYS, "space", "first", "last", top.alias("top_y"), bottom.alias("bottom_y")).where("bottom_y > top_y and last > first")
    above, below = (integral.select("page_id", F.col("y").alias(f"{n}_y"), F.col("sums").alias(n)) for n in ("top", "bottom"))
    band = band.join(above, ["page_id", "top_y"]).join(below, ["page_id", "bottom_y"])
    ink = F.transform(F.sequence(F.col("first"), F.col("last") - 1), lambda x: F.get("bottom", x + 1) - F.get("bottom", x) - F.get("top", x + 1) + F.get("top", x))
    band = band.select(*_KEYS, "space", "first", "last", F.greatest(F.lit(2), half_even(0.10 * (F.col("bottom_y") - F.col("top_y")))).alias("least"), ink.alias("ink"))
    strong = band.select(*_KEYS, "first", "least", F.posexplode("ink").alias("at", "n")).where("n >= least")
    runs = islands(strong.select(*_KEYS, "at"), _KEYS, "at", 2).join(band, _KEYS)
    width = F.col("end") - F.col("start") + 1
    runs = runs.where((width >= F.greatest(F.lit(4), half_even(0.26 * F.col("space")))) & (width <= half_even(3.2 * F.col("space"))))
    own = F.slice("ink", F.col("start") + 1, width)
    weight = F.aggregate(own, F.lit(0), lambda a, n: a + n)
    moment = F.aggregate(F.transform(own, lambda n, k: n * (k + F.col("start") + F.col("first"))), F.lit(0), lambda a, n: a + n)
    middle = half_even(moment / weight)
    near = F.array(*[half_even(middle + k * F.col("space")) for k in (0.0, -0.18, 0.18)])
    found = runs.select(*_KEYS, "first", "last", F.explode(near).alias("x")).where("x >= first and x < last").select(*_KEYS, "x")
    return grid.unionByName(found).distinct()


# ------------------------------------------------------------------- densities
def _stencil(part: np.ndarray, dy: np.ndarray, x0: np.ndarray, x1: np.ndarray, rx: int, ry: int) -> tuple[np.ndarray, ...]:
    member = (part[:, None] == np.arange(len(PARTS))).astype(np.int64)
    outer = part == PARTS.index("outer")
    reach = np.array([max((int(y) for y, a, b in zip(dy[outer], x0[outer], x1[outer]) if a <= dx <= b), default=-1) for dx in range(-rx, rx + 1)])
    return dy + ry, x0, x1, member, outer, reach


def _numbers(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins and ends in the values, and the values."""
    return lists.offsets.to_numpy(), lists.values.to_numpy()


def stencil_counts(rows: DataFrame, candidates: DataFrame, cleaned: DataFrame, raw: DataFrame, spans: DataFrame) -> DataFrame:
    """(page_id, staff, pitch_step, x, n, raw): ink under each part of the stencil
    at each candidate whose window is on the page.

    ``n`` has a count for each of PARTS on the cleaned raster, then the numbers of
    window rows and of columns whose outer ink is enough; ``raw`` has outer, inner
    and core on the raw raster.  A pitch row fetches the few rows of the integral
    tables that its windows span, once for all its candidates.
    """
    rows = rows.where("y - ry >= 0 and y + ry + 1 <= height")
    fits = candidates.join(rows.select(*_KEYS, "rx", "width"), _KEYS).where("x - rx >= 0 and x + rx + 1 <= width")
    listed = fits.groupBy(*_KEYS).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    lines = rows.select(*_KEYS, F.explode(F.sequence(F.col("y") - F.col("ry"), F.col("y") + F.col("ry") + 1)).alias("y"))
    both = cleaned.join(raw.withColumnRenamed("sums", "raw_sums"), ["page_id", "y"])
    fetched = lines.join(both, ["page_id", "y"]).groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("y", "sums", "raw_sums"))).alias("r"))
    number = F.array_position(F.array(*[F.lit(p) for p in PARTS]), F.col("part")).cast("int") - 1
    stencils = spans.groupBy("rx", "ry").agg(F.collect_list(F.struct(number.alias("part"), "dy", "x0", "x1")).alias("spans"))
    work = rows.select(*_KEYS, "rx", "ry").join(listed, _KEYS).join(fetched, _KEYS).join(F.broadcast(stencils), ["rx", "ry"])
    work = work.select(*_KEYS, F.col("rx").cast("int").alias("rx"), F.col("ry").cast("int").alias("ry"), F.col("xs").cast("array<int>").alias("xs"), F.col("r.sums").alias("sums"), F.col("r.raw_sums").alias("raw_sums"), "spans")
    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in _KEYS) + ", x int, n array<int>, raw array<int>"
    known: dict = {}

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        rxs, rys = (batch.column(k).to_numpy() for k in ("rx", "ry"))
        at, xs = _numbers(batch.column("xs"))
        tables = []
        for name in ("sums", "raw_sums"):
            lists = batch.column(name)
            tables.append((lists.offsets.to_numpy(), *_numbers(lists.values)))
        counts, rough = [], []
        for k, (rx, ry) in enumerate(zip(rxs.tolist(), rys.tolist())):
            if (rx, ry) not in known:
                known[rx, ry] = _stencil(*(c.to_numpy() for c in batch.column("spans").slice(k, 1).flatten().flatten()), rx, ry)
            r, x0, x1, member, outer, reach = known[rx, ry]
            x = xs[at[k] : at[k + 1], None]
            sums, raw_sums = (values[inner[of[k]] : inner[of[k + 1]]].reshape(of[k + 1] - of[k], -1) for of, inner, values in tables)

            def inked(sums: np.ndarray, x=x, r=r, x0=x0, x1=x1) -> np.ndarray:
                return sums[r + 1, x + x1 + 1] - sums[r + 1, x + x0] - sums[r, x + x1 + 1] + sums[r, x + x0]

            n, own = inked(sums), inked(raw_sums) @ member
            column = x + np.arange(-rx, rx + 1)
            low, high = ry - reach, ry + reach + 1
            tall = sums[high, column + 1] - sums[high, column] - sums[low, column + 1] + sums[low, column]
            row_hits = (n[:, outer] >= max(2, int(0.18 * (2 * rx + 1)))).sum(1)
            column_hits = (tall >= max(2, int(0.18 * (2 * ry + 1)))).sum(1)
            counts.append(np.column_stack([n @ member, row_hits, column_hits]).astype(np.int32))
            rough.append(own[:, [PARTS.index(p) for p in ("outer", "inner", "core")]].astype(np.int32))
        at = at.astype(np.int64)
        keys = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(at)))
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1]), pa.array(c.ravel())) for c in (np.concatenate(counts), np.concatenate(rough))]
        return pa.RecordBatch.from_arrays([*[batch.column(k).take(keys) for k in _KEYS], pa.array(xs[at[0] : at[-1]]), *lists], [*_KEYS, "x", "n", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield counted(batch.slice(start, ROWS_AT_ONCE))

    return work.mapInArrow(run, schema)


def scored(counts: DataFrame, rows: DataFrame, areas: DataFrame) -> DataFrame:
    """(page_id, staff, pitch_step, x, y, kind, score, black_density, center_density)
    of every candidate: the first of strictly filled, open, loosely filled that
    fits (else kind is null and the score the better one); the kind then decided
    anew by ring and core, or by the raw raster where erased lines took the ink.
    """
    packed = areas.groupBy("rx", "ry").agg(F.map_from_entries(F.collect_list(F.struct("part", "area"))).alias("areas"))
    held = counts.join(rows.select(*_KEYS, "pitch_y", "space", "rx", "ry"), _KEYS).join(F.broadcast(packed), ["rx", "ry"])
    area = lambda p: F.element_at("areas", p)
    part = {p: F.coalesce(F.get("n", F.lit(k)) / area(p), F.lit(0.0)) for k, p in enumerate(PARTS)}
    ring = (F.get("n", F.lit(0)) - F.get("n", F.lit(1))) / (area("outer") - area("inner"))
    rough = {p: F.get("raw", F.lit(k)) / area(p) for k, p in enumerate(("outer", "inner", "core"))}
    d = held.select(
        *_KEYS, "x", F.col("pitch_y").alias("y"), "space", *[c.alias(p) for p, c in part.items()], ring.alias("ring"), *[c.alias(f"raw_{p}") for p, c in rough.items()],
        (F.get("n", F.lit(8)) / (2 * F.col("ry") + 1)).alias("rows"), (F.get("n", F.lit(9)) / (2 * F.col("rx") + 1)).alias("columns"),
    )
    c = F.col
    d = d.withColumn("filled", c("outer") - 0.38 * c("surround"))
    d = d.withColumn("open", 0.72 * c("ring") + 0.30 * F.greatest(F.lit(0.0), 0.35 - c("inner")) - 0.22 * c("surround"))
    d = d.withColumn("balance", F.least("left", "right") / F.greatest(c("left"), c("right"), F.lit(1e-6)))
    covered = (c("rows") >= 0.30) & (c("columns") >= 0.30)
    strict = covered & (c("filled") >= 0.36) & (c("inner") >= 0.30) & (c("left") >= 0.20) & (c("right") >= 0.20) & (c("balance") >= 0.25)
    hollow = covered & (c("open") >= 0.31) & (c("ring") >= 0.31) & (c("inner") <= 0.28) & (c("left") >= 0.23) & (c("right") >= 0.23)
    hollow = hollow & (F.greatest("top", "bottom") >= 0.18) & (c("balance") >= 0.30)
    loose = covered & (c("filled") >= 0.34) & (c("outer") >= 0.34) & (c("inner") >= 0.30) & (F.greatest("left", "right") >= 0.20) & (c("surround") <= 0.42) & (c("balance") >= 0.24)
    first = F.when(strict, "filled").when(hollow, "open").when(loose, "filled")
    score = F.when(strict, c("filled")).when(hollow, c("open")).when(loose, c("filled")).otherwise(F.greatest("filled", "open"))
    sure_open = 0.70 * c("ring") + 0.45 * F.greatest(F.lit(0.0), 0.28 - c("core")) + 0.30 * F.greatest(F.lit(0.0), c("ring") - c("core"))
    sure_filled = 0.70 * c("core") + 0.35 * c("inner") + 0.20 * c("outer")
    solid = (c("raw_core") >= 0.68) & (c("raw_inner") >= 0.58) & (c("raw_outer") >= 0.62)
    solid = solid & ((c("raw_core") - c("core") >= 0.42) | (c("raw_inner") - c("inner") >= 0.42))
    opened = (sure_open >= 0.43) & (c("core") <= 0.24) & (c("ring") >= 0.31) & (sure_open >= sure_filled * 0.92)
    kind = F.when(first.isNull(), F.lit(None)).when(solid, "filled").when(opened, "open").otherwise("filled")
    dark = [F.when(first.isNotNull() & solid, c(f"raw_{p}")).otherwise(c(p)).alias(name) for p, name in (("outer", "black_density"), ("inner", "center_density"))]
    return d.select(*_KEYS, "x", "y", "space", first.alias("first_kind"), kind.alias("kind"), score.alias("score"), *dark)


# ----------------------------------------------------------------- suppression
def kept_notes(found: DataFrame) -> DataFrame:
    """Notes that stay: first among the candidates of a pitch row, with a reach of
    the staff's size, then among all that stayed on the staff, within 8 pixels.
    Ties of score: the higher pitch row, then the smaller x.  Scores are cut first:
    with the filter on kind pushed into them, inferring constraints has no end."""

    def conflict(reach) -> callable:
        return lambda a, b: (F.abs(a["x"] - b["x"]) <= reach(a)) & (F.abs(a["y"] - b["y"]) <= F.greatest(F.lit(4.0), 1.10 * reach(a)))

    fields = ["pitch_step", "x", "y", "kind", "black_density", "center_density", "reach"]
    items = cut(found).where("kind is not null").withColumn("reach", F.greatest(F.lit(5), half_even(F.col("space") * 0.72)))
    items = items.withColumn("seq", F.col("pitch_step").cast("long") * (1 << 32) + F.col("x"))
    own = [f for f in fields if f != "pitch_step"]
    rows = boxes.suppress(items, _KEYS, own, conflict(lambda a: a["reach"]))
    both = boxes.suppress(rows, ["page_id", "staff"], fields, conflict(lambda a: F.lit(8)))
    return both.drop("reach", "seq")
