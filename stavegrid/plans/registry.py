"""One query for each geometry operator, with the SQL that says the same.

The tables are viewed as pages by :mod:`stavegrid.sources.adapters`; names
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stavegrid.operators import beams, boxes, marks, masks, raster, runs, staves, symbols
from stavegrid.sources import adapters

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    from stavegrid.plans import mark_queries, note_queries, page_queries  # noqa: F401

    return {**_QUERIES, **page_queries.queries()}


def oracle_sql() -> dict[str, str]:
    from stavegrid.plans import mark_queries, note_queries  # noqa: F401

    return dict(_SQL)


# --------------------------------------------------------------------- inputs
_GRAY = """gray AS (SELECT vec_id // 100 AS page_id, CAST(vec_id % 100 AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x,
  CAST(greatest(0, least(255, floor((CAST(embedding[i] AS DOUBLE) + 1) * 127.5))) AS INTEGER) AS g
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
_INK = _GRAY + ", ink AS (SELECT page_id, y, x FROM gray WHERE g < 117)"
_RUNS = _INK + """, marked AS (SELECT page_id, y, x, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS island FROM ink),
  runs AS (SELECT page_id, y, min(x) AS x0, max(x) AS x1 FROM marked GROUP BY page_id, y, island)"""
_POINTS = """points AS (SELECT user_id AS staff, event_id AS seq, epoch_us(ts) / 1e6 AS x, value AS y, value AS score, event_type AS kind FROM events)"""
_BOXES = """boxes AS (SELECT *, x0 + w AS x1, y0 + h AS y1, w * h - CAST(round_even(l_tax * 100, 0) AS INTEGER) AS area FROM (
  SELECT l_suppkey AS page_id, CAST(l_linenumber AS INTEGER) AS staff, l_orderkey * 10 + l_linenumber AS seq,
    CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS x0, CAST(floor(l_extendedprice / 50) AS INTEGER) AS y0,
    CAST(l_quantity AS INTEGER) + 1 AS w, CAST(round_even(l_discount * 100, 0) AS INTEGER) * 4 + 3 AS h, l_tax, l_extendedprice AS score FROM lineitem))"""


def _gray(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.gray_raster(adapters.table(spark, sf, "embeddings"))


def _ink(spark: SparkSession, sf: str, level: int = 117) -> DataFrame:
    return _gray(spark, sf).where(F.col("g") < level).select("page_id", "y", "x")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.event_points(adapters.table(spark, sf, "events"))


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.lineitem_boxes(adapters.table(spark, sf, "lineitem"))


def _roles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The boxes of odd line numbers and those of even ones."""
    every = _boxes(spark, sf)
    return every.where("staff % 2 = 1"), every.where("staff % 2 = 0")


# --------------------------------------------------------------------- raster
@_query(f"""WITH {_GRAY}, c AS (SELECT page_id, g, CAST(count(*) AS DOUBLE) AS n FROM gray GROUP BY ALL),
s AS (SELECT page_id, g, sum(n) OVER r AS wb, sum(n * g) OVER r AS sb, sum(n) OVER (PARTITION BY page_id) AS w, sum(n * g) OVER (PARTITION BY page_id) AS s FROM c WINDOW r AS (PARTITION BY page_id ORDER BY g)),
v AS (SELECT page_id, g, wb * (w - wb) * (sb / wb - (s - sb) / (w - wb)) * (sb / wb - (s - sb) / (w - wb)) AS b FROM s WHERE w > wb)
SELECT p.page_id, coalesce(b.g, 180) AS otsu FROM (SELECT DISTINCT page_id FROM gray) p LEFT JOIN (SELECT page_id, g FROM v QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY b DESC, g) = 1) b USING (page_id)""")
def ras1_otsu_threshold(spark, sf):
    return raster.otsu_threshold(_gray(spark, sf))


@_query(f"""WITH {_GRAY}, c AS (SELECT page_id, g, CAST(count(*) AS DOUBLE) AS n FROM gray GROUP BY ALL),
s AS (SELECT page_id, g, sum(n) OVER r AS wb, sum(n * g) OVER r AS sb, sum(n) OVER (PARTITION BY page_id) AS w, sum(n * g) OVER (PARTITION BY page_id) AS s FROM c WINDOW r AS (PARTITION BY page_id ORDER BY g)),
v AS (SELECT page_id, g, wb * (w - wb) * (sb / wb - (s - sb) / (w - wb)) * (sb / wb - (s - sb) / (w - wb)) AS b FROM s WHERE w > wb),
t AS (SELECT page_id, least(255, greatest(0, g - 10)) AS t FROM v QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY b DESC, g) = 1)
SELECT page_id, y, x FROM gray JOIN t USING (page_id) WHERE g < t""")
def ras2_binarize(spark, sf):
    return raster.binarize(_gray(spark, sf), offset=-10, low=0, high=255)


_REACH = _GRAY + """, ink AS (SELECT page_id, y, x FROM gray WHERE g < 97), marked AS (SELECT page_id, y, x, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS island FROM ink),
 runs AS (SELECT page_id, y, min(x) AS x0, max(x) AS x1 FROM marked GROUP BY page_id, y, island), ids AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x0) AS id FROM runs),
 touch AS (SELECT a.page_id, a.id AS u, b.id AS v FROM ids a JOIN ids b ON a.page_id = b.page_id AND b.y = a.y + 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
 ways AS (SELECT page_id, u, v FROM touch UNION ALL SELECT page_id, v, u FROM touch),
 reach AS (SELECT page_id, id AS u, id AS v FROM ids UNION SELECT r.page_id, r.u, w.v FROM reach r JOIN ways w ON r.page_id = w.page_id AND r.v = w.u),
 named AS (SELECT page_id, u AS id, min(v) AS label FROM reach GROUP BY ALL), labelled AS (SELECT * FROM ids JOIN named USING (page_id, id))"""


@_query(f"""WITH RECURSIVE {_REACH} SELECT page_id, y, x0, x1 FROM labelled QUALIFY sum(x1 - x0 + 1) OVER (PARTITION BY page_id, label) >= 3""")
def ras3_remove_specks(spark, sf):
    return masks.drop_specks(runs.ink_runs(_ink(spark, sf, 97)), 3)


@_query(f"""WITH RECURSIVE {_REACH} SELECT page_id, label, min(x0) AS x0, min(y) AS y0, max(x1) + 1 AS x1, max(y) + 1 AS y1, CAST(sum(x1 - x0 + 1) AS BIGINT) AS area FROM labelled GROUP BY page_id, label""")
def cc1_components(spark, sf):
    return masks.component_boxes(masks.label_runs(runs.ink_runs(_ink(spark, sf, 97))))


@_query(f"""WITH {_INK} SELECT page_id, y, count(i.x) AS n FROM (SELECT DISTINCT page_id, y FROM gray) LEFT JOIN ink i USING (page_id, y) GROUP BY page_id, y""")
def ras4_row_projection(spark, sf):
    return raster.row_projection(_ink(spark, sf), _gray(spark, sf).select("page_id", "y").distinct())


@_query(f"WITH {_INK} SELECT page_id, x, count(*) AS n FROM ink WHERE y >= 20 AND y < 60 GROUP BY page_id, x")
def ras5_column_projection(spark, sf):
    return raster.column_projection(_ink(spark, sf), 20, 60)


@_query(f"""WITH {_INK}, p AS (SELECT page_id, y, count(i.x) AS n FROM (SELECT DISTINCT page_id, y FROM gray) LEFT JOIN ink i USING (page_id, y) GROUP BY page_id, y)
SELECT page_id, round(quantile_cont(n, 0.995), 6) AS strong FROM p GROUP BY page_id""")
def ras6_percentile(spark, sf):
    return raster.strong_rows(ras4_row_projection(spark, sf)).select("page_id", F.round("strong", 6).alias("strong"))


@_query(f"""WITH {_INK} SELECT page_id, round(sum(y * n) / greatest(1, sum(n)), 6) AS center FROM (SELECT page_id, y, count(*) AS n FROM ink GROUP BY ALL) GROUP BY page_id""")
def ras7_centroid(spark, sf):
    rows = _ink(spark, sf).groupBy("page_id", "y").agg(F.count("*").alias("n"))
    return rows.groupBy("page_id").agg(F.round(raster.centroid(F.col("y"), F.col("n")), 6).alias("center"))


@_query(f"WITH {_RUNS} SELECT DISTINCT page_id, y + d AS y, x0, x1 FROM runs, (VALUES (-1), (0), (1)) t(d)")
def ras8_dilate_rows(spark, sf):
    return raster.dilate_rows(runs.ink_runs(_ink(spark, sf)))


@_query(f"""WITH {_POINTS}, c AS (SELECT staff, CAST(round_even(y, 0) AS INTEGER) AS v, count(*) AS n FROM points GROUP BY ALL)
SELECT staff, mode, round(median, 6) AS median FROM (SELECT staff, v AS mode FROM c QUALIFY row_number() OVER (PARTITION BY staff ORDER BY n DESC, v) = 1) JOIN (SELECT staff, median(y) AS median FROM points GROUP BY staff) USING (staff)""")
def ras9_mode_median(spark, sf):
    return raster.mode_and_median(_points(spark, sf), "staff", "y").withColumn("median", F.round("median", 6))


# ----------------------------------------------------------------------- runs
@_query(f"WITH {_RUNS} SELECT page_id, y, x0, x1 FROM runs")
def run1_islands(spark, sf):
    return runs.ink_runs(_ink(spark, sf))


@_query(f"""WITH {_RUNS} SELECT page_id, y, x0 AS start, x1 AS "end", x1 - x0 + 1 AS length FROM runs QUALIFY row_number() OVER (PARTITION BY page_id, y ORDER BY x1 - x0 DESC, x0) = 1""")
def run2_longest_run(spark, sf):
    return runs.longest_run(_ink(spark, sf), ["page_id", "y"], "x")


@_query(f"""WITH {_INK}, m AS (SELECT page_id, x, y, CASE WHEN y - lag(y) OVER w <= 8 THEN 0 ELSE 1 END AS new FROM ink WINDOW w AS (PARTITION BY page_id, x ORDER BY y)),
i AS (SELECT page_id, x, y, sum(new) OVER (PARTITION BY page_id, x ORDER BY y) AS island FROM m), r AS (SELECT page_id, x, min(y) AS start, max(y) AS "end" FROM i GROUP BY page_id, x, island)
SELECT page_id, x, start, "end", "end" - start + 1 AS length FROM r QUALIFY row_number() OVER (PARTITION BY page_id, x ORDER BY "end" - start DESC, start) = 1""")
def run3_column_run(spark, sf):
    return runs.longest_column_run(_ink(spark, sf))


@_query(f"""WITH {_INK}, s AS (SELECT page_id, x FROM ink GROUP BY page_id, x HAVING count(*) >= 27), m AS (SELECT page_id, x - row_number() OVER (PARTITION BY page_id ORDER BY x) AS island FROM s),
g AS (SELECT page_id, count(DISTINCT island) AS groups FROM m GROUP BY page_id) SELECT page_id, coalesce(groups, 0) AS groups FROM (SELECT DISTINCT page_id FROM ink) LEFT JOIN g USING (page_id)""")
def run4_projection_groups(spark, sf):
    return runs.projection_groups(_ink(spark, sf), "x", 27)


@_query(f"""WITH {_RUNS}, c AS (SELECT page_id, y, greatest(x0, 5) AS x0, least(x1, 49) AS x1 FROM runs WHERE y >= 10 AND y < 80 AND x1 >= 5 AND x0 < 50) SELECT * FROM c WHERE x1 - x0 + 1 >= 3""")
def run5_long_runs(spark, sf):
    found = runs.ink_runs(_ink(spark, sf))
    regions = found.select("page_id").distinct().select("page_id", F.lit(5).alias("x0"), F.lit(10).alias("y0"), F.lit(50).alias("x1"), F.lit(80).alias("y1"))
    return runs.long_runs(found, regions, 3)


# ---------------------------------------------------------------------- masks
_MORE = _INK + ", more AS (SELECT page_id, y, x FROM gray WHERE g >= 110 AND g < 125)"
_RECT = "rect AS (SELECT page_id, min(x) + 3 AS x0, min(y) + 3 AS y0, min(x) + 20 AS x1, min(y) + 30 AS y1 FROM ink GROUP BY page_id)"


def _band(spark, sf):
    return _gray(spark, sf).where("g >= 110 AND g < 125").select("page_id", "y", "x")


def _rectangles(ink: DataFrame) -> DataFrame:
    x, y = F.min("x"), F.min("y")
    return ink.groupBy("page_id").agg((x + 3).alias("x0"), (y + 3).alias("y0"), (x + 20).alias("x1"), (y + 30).alias("y1"))


@_query(f"WITH {_MORE} SELECT page_id, y, x FROM ink ANTI JOIN more USING (page_id, y, x)")
def msk1_difference(spark, sf):
    return masks.difference(_ink(spark, sf), _band(spark, sf))


@_query(f"WITH {_MORE} SELECT page_id, y, x FROM ink SEMI JOIN more USING (page_id, y, x)")
def msk1_intersection(spark, sf):
    return masks.intersect(_ink(spark, sf), _band(spark, sf))


@_query(f"WITH {_INK}, {_RECT} SELECT i.page_id, y, x FROM ink i JOIN rect r ON i.page_id = r.page_id AND x >= x0 - 2 AND x < x1 + 2 AND y >= y0 - 1 AND y < y1 + 1")
def msk2_mask_regions(spark, sf):
    ink = _ink(spark, sf)
    return masks.within(ink, _rectangles(ink), 2, 1)


@_query(f"""WITH {_INK} SELECT page_id, y, x FROM ink WHERE NOT ((y BETWEEN 18 AND 22 OR y BETWEEN 38 AND 42) AND x >= 5 - 16 AND x < 40 + 16)""")
def msk3_erase_lines(spark, sf):
    ink = _ink(spark, sf)
    lines = ink.select("page_id").distinct().select("page_id", F.explode(F.array(F.lit(20.3), F.lit(39.5))).alias("y"), F.lit(5).alias("x0"), F.lit(40).alias("x1"), F.lit(16.0).alias("space"))
    return masks.erase_lines(ink, lines)


@_query(f"""WITH {_INK} SELECT page_id, y, x FROM ink WHERE NOT (((x - 30) / 13.0) * ((x - 30) / 13.0) + ((y - 40) / 8.0) * ((y - 40) / 8.0) <= 1.0) AND NOT (x >= 48 AND x < 53 AND y >= 8 AND y < 73)""")
def msk4_erase_marks(spark, sf):
    ink = _ink(spark, sf)
    pages = ink.select("page_id").distinct()
    ellipses = pages.select("page_id", F.lit(30).alias("cx"), F.lit(40).alias("cy"), F.lit(13.0).alias("rx"), F.lit(8.0).alias("ry"))
    return masks.erase_marks(ink, ellipses, pages.select("page_id", F.lit(50).alias("x"), F.lit(10).alias("y0"), F.lit(70).alias("y1")))


# ---------------------------------------------------------------------- boxes
@_query(f"""WITH {_BOXES} SELECT a.page_id, a.seq AS a, b.seq AS b FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.staff % 2 = 1 AND b.staff % 2 = 0
AND least(a.x1, b.x1 + 3) > greatest(a.x0, b.x0 - 3) AND least(a.y1, b.y1 + 3) > greatest(a.y0, b.y0 - 3)""")
def box1_intersections(spark, sf):
    found = boxes.near_pairs(*_roles(spark, sf), ["page_id"], lambda a, b: boxes.intersects(a, b, 3), 3)
    return found.select("a.page_id", F.col("a.seq").alias("a"), F.col("b.seq").alias("b"))


@_query(f"WITH {_BOXES} SELECT page_id, staff, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM boxes GROUP BY page_id, staff")
def box2_hull(spark, sf):
    return _boxes(spark, sf).groupBy("page_id", "staff").agg(*boxes.hull(F.count("*").alias("n")))


@_query()
def box3_merge_nearby(spark, sf):
    """First fit is an ordered walk over growing hulls; tests compare with brute force."""
    return boxes.merge_boxes(_boxes(spark, sf), ["page_id", "staff"], 4.7, 6.4)


@_query(f"""WITH {_BOXES} SELECT a.page_id, a.seq AS box, b.seq AS point FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.staff % 2 = 1 AND b.staff % 2 = 0
AND (b.x0 + b.x1) * 0.5 BETWEEN a.x0 - 2.5 AND a.x1 + 2.5 AND (b.y0 + b.y1) * 0.5 BETWEEN a.y0 - 2.5 AND a.y1 + 2.5""")
def box4_points_in_boxes(spark, sf):
    middle = lambda b, c: (b(f"{c}0") + b(f"{c}1")) * 0.5
    found = boxes.near_pairs(*_roles(spark, sf), ["page_id"], lambda a, b: boxes.holds_point(a, middle(b, "x"), middle(b, "y"), 2.5), 2.5)
    return found.select("a.page_id", F.col("a.seq").alias("box"), F.col("b.seq").alias("point"))


# ---------------------------------------------------------------- suppression
def _fold_sql(keys: str, source: str, test: str, inputs: str) -> str:
    """Greedy suppression in SQL: each item a list of itself, folded into the list kept so far."""
    return f"""WITH {inputs}, listed AS (SELECT {keys}, list_transform(list(i ORDER BY score DESC, seq), lambda i: [i]) AS items FROM {source} i GROUP BY {keys}),
kept AS (SELECT {keys}, unnest(list_reduce(items, lambda a, i: CASE WHEN len(list_filter(a, lambda k: {test})) > 0 THEN a ELSE list_concat(a, i) END)) AS k FROM listed)
SELECT {keys}, k.seq AS seq FROM kept"""


_NEAR_BOXES = "least(i[1].x1, k.x1) + {m} > greatest(i[1].x0, k.x0) - {m} AND least(i[1].y1, k.y1) + {m} > greatest(i[1].y0, k.y0) - {m}"
_BOX = ["x0", "y0", "x1", "y1"]


@_query(_fold_sql("page_id, staff", "boxes", _NEAR_BOXES.format(m=3), _BOXES))
def nms1_boxes(spark, sf):
    return boxes.suppress(_boxes(spark, sf), ["page_id", "staff"], _BOX, boxes.boxes_conflict(3), reach=(F.col("x0") - 3, F.col("x1") + 3)).select("page_id", "staff", "seq")


@_query(_fold_sql("staff", "points", "abs(i[1].x - k.x) <= 43200 AND abs(i[1].y - k.y) <= 47520", _POINTS))
def nms2_notes(spark, sf):
    return boxes.suppress(_points(spark, sf), ["staff"], ["x", "y"], boxes.points_conflict(43200)).select("staff", "seq")


@_query(_fold_sql("page_id, staff", "boxes", "abs((i[1].x0 + i[1].x1) * 0.5 - (k.x0 + k.x1) * 0.5) <= 80 AND abs((i[1].y0 + i[1].y1) * 0.5 - (k.y0 + k.y1) * 0.5) <= 40", _BOXES))
def nms3_ledger_lines(spark, sf):
    return boxes.suppress(_boxes(spark, sf), ["page_id", "staff"], _BOX, boxes.centers_conflict(80, 40), reach=(F.col("x0") + F.col("x1"), F.col("x0") + F.col("x1") + 161)).select("page_id", "staff", "seq")


@_query(_fold_sql("page_id, staff", "boxes", "abs(i[1].x0 - k.x0) <= 60.5 AND abs(i[1].x1 - k.x1) <= 60.5", _BOXES))
def nms4_beam_links(spark, sf):
    return boxes.suppress(_boxes(spark, sf), ["page_id", "staff"], ["x0", "x1"], boxes.ends_conflict(60.5), reach=(F.col("x0"), F.col("x0") + 61)).select("page_id", "staff", "seq")


@_query(_fold_sql("page_id", "boxes", "least(i[1].x1, k.x1 + 3) > greatest(i[1].x0, k.x0 - 3) AND least(i[1].y1, k.y1 + 3) > greatest(i[1].y0, k.y0 - 3)", _BOXES))
def nms5_text_regions(spark, sf):
    return boxes.suppress_boxes(_boxes(spark, sf), ["page_id"], _BOX, 3).select("page_id", "seq")



# --------------------------------------------------------------------- staves
@_query(f"""WITH {_GRAY}, ink AS (SELECT page_id, y, x FROM gray WHERE g < 140), p AS (SELECT page_id, y, count(i.x) AS n FROM (SELECT DISTINCT page_id, y FROM gray) LEFT JOIN ink i USING (page_id, y) GROUP BY page_id, y),
s AS (SELECT page_id, greatest(64 * 0.22, quantile_cont(n, 0.995) * 0.62) AS t FROM p GROUP BY page_id), h AS (SELECT p.* FROM p JOIN s USING (page_id) WHERE n > t),
b AS (SELECT page_id, y, n, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS k FROM h),
bands AS (SELECT page_id, min(y) AS top, max(y) AS bottom, sum(y * n) / greatest(1, sum(n)) AS center, max(n) AS strength FROM b GROUP BY page_id, k),
cols AS (SELECT DISTINCT b.page_id, top, x FROM bands b JOIN ink i ON b.page_id = i.page_id AND i.y BETWEEN top AND bottom),
m AS (SELECT *, x - row_number() OVER (PARTITION BY page_id, top ORDER BY x) AS k FROM cols), r AS (SELECT page_id, top, min(x) AS x0, max(x) AS x1 FROM m GROUP BY page_id, top, k),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY page_id, top ORDER BY x1 - x0 DESC, x0) = 1)
SELECT page_id, round(center, 6) AS y, bottom - top + 1 AS thickness, x0, x1, strength FROM bands JOIN best USING (page_id, top) WHERE x1 > x0 AND x1 - x0 + 1 >= 64 * 0.35""")
def stf1_line_candidates(spark, sf):
    rows = _gray(spark, sf).select("page_id", "y").distinct()
    return staves.line_candidates(_ink(spark, sf, 140), rows, 64).withColumn("y", F.round("y", 6))


_LINES = """lines AS (SELECT o_custkey AS page_id, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) / 4 AS y FROM orders)"""


def _lines(spark, sf):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return adapters.table(spark, sf, "orders").select(F.col("o_custkey").alias("page_id"), (day / 4).alias("y"))


_SPACE = f"""{_LINES}, gaps AS (SELECT page_id, lead(y) OVER (PARTITION BY page_id ORDER BY y) - y AS gap FROM lines), useful AS (SELECT * FROM gaps WHERE gap BETWEEN 6 AND 80),
 mode AS (SELECT page_id, v FROM (SELECT page_id, CAST(round_even(gap, 0) AS INTEGER) AS v, count(*) AS n FROM useful GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, v) = 1),
 near AS (SELECT page_id, coalesce(median(gap) FILTER (WHERE abs(gap - v) <= 2), median(gap)) AS space FROM useful JOIN mode USING (page_id) GROUP BY page_id),
 spaces AS (SELECT page_id, space FROM (SELECT DISTINCT page_id FROM lines) LEFT JOIN near USING (page_id))"""


@_query(f"WITH {_SPACE} SELECT page_id, round(space, 6) AS space FROM spaces")
def stf2_staff_space(spark, sf):
    return staves.staff_space(_lines(spark, sf)).withColumn("space", F.round("space", 6))


_STAFF_LINES = """lines AS (SELECT user_id AS page_id, epoch_us(ts) / 3.6e9 AS y, 40.0 AS space FROM events)"""


def _staff_lines(spark, sf):
    return adapters.table(spark, sf, "events").select(F.col("user_id").alias("page_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("y"), F.lit(40.0).alias("space"))


@_query(f"""WITH RECURSIVE {_STAFF_LINES}, n AS (SELECT *, row_number() OVER w - 1 AS k, lead(y, 1) OVER w AS b, lead(y, 2) OVER w AS c, lead(y, 3) OVER w AS d, lead(y, 4) OVER w AS e FROM lines WINDOW w AS (PARTITION BY page_id ORDER BY y)),
fit AS (SELECT page_id, k, y AS top, e AS bottom FROM n WHERE abs(b - y - space) <= 30 AND abs(c - b - space) <= 30 AND abs(d - c - space) <= 30 AND abs(e - d - space) <= 30),
l AS (SELECT page_id, list_transform(list(f ORDER BY k), lambda f: [f]) AS items FROM fit f GROUP BY page_id),
t AS (SELECT page_id, list_reduce(items, lambda a, i: CASE WHEN i[1].k >= a[-1].k + 5 THEN list_concat(a, i) ELSE a END) AS kept FROM l)
SELECT page_id, staff, round(kept[staff + 1].top, 6) AS top, round(kept[staff + 1].bottom, 6) AS bottom FROM (SELECT page_id, kept, CAST(unnest(range(len(kept))) AS INTEGER) AS staff FROM t)""")
def stf3_group_staves(spark, sf):
    found = staves.group_staves(_staff_lines(spark, sf), tolerance_px=30.0)
    return found.withColumn("top", F.round("top", 6)).withColumn("bottom", F.round("bottom", 6))


@_query(f"""WITH {_BOXES}, st AS (SELECT DISTINCT page_id, staff FROM boxes), c AS (SELECT page_id, staff, seq, x0, y0, x1, y1, area, x1 - x0 AS w, y1 - y0 AS h FROM boxes WHERE x1 >= -0.5),
big AS (SELECT * FROM c WHERE h >= 20 AND w >= 5.5 AND area >= 55 QUALIFY row_number() OVER (PARTITION BY page_id, staff ORDER BY area DESC, seq) = 1),
hull AS (SELECT page_id, staff, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM c WHERE area >= 12 AND w >= 1.8 AND h >= 4.5 GROUP BY ALL HAVING max(x1) - min(x0) >= 7.5 AND max(y1) - min(y0) >= 16)
SELECT page_id, staff, coalesce(b.x0, h.x0) AS x0, coalesce(b.y0, h.y0) AS y0, coalesce(b.x1, h.x1) AS x1, coalesce(b.y1, h.y1) AS y1, CASE WHEN staff % 2 = 0 THEN 'treble' ELSE 'bass' END AS clef_type,
 greatest(42, CAST(trunc(coalesce(b.x1, h.x1, 0) + 11.0) AS INTEGER)) AS scan_x0 FROM st LEFT JOIN big b USING (page_id, staff) LEFT JOIN hull h USING (page_id, staff)""")
def stf4_clefs(spark, sf):
    found = _boxes(spark, sf)
    st = found.select("page_id", "staff").distinct().withColumn("x0", F.lit(0)).withColumn("space", F.lit(10.0)).withColumn("scan_x0", F.lit(42))
    return staves.clef_boxes(found, st)


@_query(f"""WITH {_SPACE} SELECT page_id, CAST(pitch_step AS INTEGER) AS pitch_step, round(100 + pitch_step * space / 2, 6) AS pitch_y FROM spaces, range(-10, 19) t(pitch_step) WHERE space IS NOT NULL""")
def stf5_pitch_rows(spark, sf):
    spaced = staves.staff_space(_lines(spark, sf)).where("space is not null").withColumn("top", F.lit(100.0))
    return staves.pitch_rows(spaced).select("page_id", "pitch_step", F.round("pitch_y", 6).alias("pitch_y"))


@_query(f"""WITH {_POINTS} SELECT staff, seq, round(min(abs(y - (20.0 + k * 12.5 / 2))), 6) AS distance FROM points, range(-10, 19) t(k) GROUP BY staff, seq""")
def stf6_pitch_distance(spark, sf):
    distance = staves.pitch_distance(F.col("y"), F.lit(20.0), F.lit(12.5))
    return _points(spark, sf).select("staff", "seq", F.round(distance, 6).alias("distance"))


# ----------------------------------------------------------------------- text
_TEXT20 = "x1 - x0 BETWEEN 2 AND 37 AND y1 - y0 BETWEEN 5 AND 35 AND area / greatest(1, (x1 - x0) * (y1 - y0)) BETWEEN 0.08 AND 0.82 AND NOT (x1 - x0 <= 4.4 AND y1 - y0 >= 29)"
_LIGHT = _BOXES + ", light AS (SELECT page_id, staff, seq, x0, y0, x1, y1, CAST(trunc(area * CAST(0.7 AS DOUBLE)) AS INTEGER) AS area, score FROM boxes)"


def _light(spark, sf):
    return _boxes(spark, sf).withColumn("area", (F.col("area") * 0.7).cast("int"))


@_query(f"WITH {_LIGHT} SELECT page_id, seq FROM light WHERE {_TEXT20}")
def txt1_text_parts(spark, sf):
    return _light(spark, sf).where(marks.is_text_part(F.col, F.lit(20.0))).select("page_id", "seq")


@_query(f"""WITH {_LIGHT}, p AS (SELECT * FROM light WHERE {_TEXT20}) SELECT a.page_id, a.staff, a.seq FROM p a JOIN p b ON a.page_id = b.page_id AND a.staff = b.staff AND a.seq <> b.seq
AND abs((a.y0 + a.y1) * 0.5 - (b.y0 + b.y1) * 0.5) <= 13.6 AND greatest(0, b.x0 - a.x1, a.x0 - b.x1) <= 35 GROUP BY ALL HAVING count(*) >= 2""")
def txt2_text_clusters(spark, sf):
    return marks.in_text_cluster(_light(spark, sf), ["page_id", "staff"], 20.0)


_PHRASES = _BOXES + """, m AS (SELECT page_id, staff, seq, x0, y0, x1, y1, CASE WHEN x0 - lag(x1) OVER w <= 27 AND least(y1, lag(y1) OVER w) - greatest(y0, lag(y0) OVER w) >= -500 THEN 0 ELSE 1 END AS new FROM boxes WINDOW w AS (PARTITION BY page_id, staff ORDER BY x0, seq)),
 i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY page_id, staff ORDER BY x0, seq) AS BIGINT) AS phrase FROM m), phrases AS (SELECT page_id, staff, phrase, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM i GROUP BY page_id, staff, phrase)"""


@_query(f"WITH {_PHRASES.replace('-500', '-5')} SELECT * FROM phrases")
def txt4_phrases(spark, sf):
    return marks.phrases(adapters.spread(_boxes(spark, sf), "page_id", "staff"), ["page_id", "staff"], 20.0)


@_query(f"""WITH {_PHRASES.replace('-500', '-5')} SELECT page_id, staff, phrase, round(least(1.0, greatest(0.0, 0.34 + 0.08 * least(5, n) + 0.20 * least(1.0, (x1 - x0) / 100.0))), 6) AS score FROM phrases WHERE n >= 3 AND x1 - x0 >= 36""")
def txt5_phrase_scores(spark, sf):
    found = marks.phrases(adapters.spread(_boxes(spark, sf), "page_id", "staff"), ["page_id", "staff"], 20.0).where("n >= 3 AND x1 - x0 >= 36")
    return found.select("page_id", "staff", "phrase", F.round(marks.phrase_score(F.col("n"), F.col("x1") - F.col("x0"), 20.0), 6).alias("score"))


# ----------------------------------------------------- stems, bars and beams
@_query(f"""WITH {_BOXES} SELECT page_id AS note, direction, x, start, "end", length FROM (SELECT page_id, CASE WHEN staff % 2 = 0 THEN 'up' ELSE 'down' END AS direction, x0 AS x, y0 AS start, y1 AS "end", y1 - y0 AS length FROM boxes)
WHERE length >= 21 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length DESC, direction DESC, x, start) = 1""")
def stm1_best_stems(spark, sf):
    direction = F.when(F.col("staff") % 2 == 0, "up").otherwise("down")
    found = _boxes(spark, sf).select(F.col("page_id").alias("note"), direction.alias("direction"), F.col("x0").alias("x"), F.col("y0").alias("start"), F.col("y1").alias("end"), (F.col("y1") - F.col("y0")).alias("length"))
    least = found.groupBy("note", "direction", "x", "length").agg(F.min("start").alias("start"), F.min("end").alias("end"))
    return marks.best_stems(least, 21.0)


@_query(f"""WITH {_RUNS}, notes AS (SELECT page_id, CAST(k AS INTEGER) AS note, 10 + 12 * k AS x, CAST(20 + 6 * k AS DOUBLE) AS y, 36.0 AS top, 44.0 AS bottom FROM (SELECT DISTINCT page_id FROM ink), range(0, 5) t(k)),
a AS (SELECT *, CASE WHEN y < top - 1.8 THEN 'above' WHEN y > bottom + 1.8 THEN 'below' END AS side FROM notes), f AS (SELECT *, CASE WHEN side = 'above' THEN top - y ELSE y - bottom END AS far FROM a WHERE side IS NOT NULL),
l AS (SELECT *, CAST(unnest(range(1, CAST(ceil(far / 4) AS BIGINT) + 2)) AS INTEGER) AS line_number FROM f), p AS (SELECT *, CASE WHEN side = 'above' THEN top - line_number * 4 ELSE bottom + line_number * 4 END AS ly FROM l),
q AS (SELECT *, CAST(round_even(ly, 0) AS INTEGER) AS row_y FROM p WHERE abs(ly - y) <= greatest(5.0, far + 4)),
c AS (SELECT DISTINCT q.page_id, note, side, line_number, q.x AS cx, i.x FROM q JOIN ink i ON q.page_id = i.page_id AND i.y BETWEEN row_y - 1 AND row_y + 1 AND i.x >= CAST(round_even(q.x - 5.8, 0) AS INTEGER) AND i.x < CAST(round_even(q.x + 5.8, 0) AS INTEGER)),
m AS (SELECT *, x - row_number() OVER (PARTITION BY page_id, note, side, line_number ORDER BY x) AS k FROM c), r AS (SELECT page_id, note, side, line_number, cx, min(x) AS x0, max(x) AS x1 FROM m GROUP BY ALL EXCLUDE (x))
SELECT 1""")
def led1_ledger_lines(spark, sf):
    ink = _ink(spark, sf)
    notes = ink.select("page_id").distinct().withColumn("note", F.explode(F.sequence(F.lit(0), F.lit(4))))
    notes = notes.select("page_id", "note", (10 + 12 * F.col("note")).alias("x"), (20 + 6 * F.col("note")).cast("double").alias("y"), F.lit(36.0).alias("top"), F.lit(44.0).alias("bottom"))
    return marks.ledger_runs(runs.ink_runs(ink), notes, 4.0)


_SQL["led1_ledger_lines"] = _SQL["led1_ledger_lines"].replace("GROUP BY ALL EXCLUDE (x))\nSELECT 1", """GROUP BY page_id, note, side, line_number, cx, k)
SELECT page_id, note, side, line_number, x0, x1, x1 - x0 + 1 AS length FROM (SELECT * FROM r WHERE x0 <= cx + 1.4 AND x1 >= cx - 1.4 QUALIFY row_number() OVER (PARTITION BY page_id, note, side, line_number ORDER BY x1 - x0 DESC, x0) = 1) WHERE x1 - x0 + 1 BETWEEN 3.0 AND 12.0""")


@_query(f"""WITH {_BOXES}, s AS (SELECT a.page_id, a.staff, a.seq FROM boxes a SEMI JOIN boxes b ON a.page_id = b.page_id AND a.staff <> b.staff AND abs(a.x0 - b.x0) <= 6.0 AND abs(a.y0 - b.y0) <= 130),
f AS (SELECT b.page_id, b.staff, b.seq, s.seq IS NOT NULL AS seen FROM boxes b LEFT JOIN s USING (page_id, staff, seq)) SELECT page_id, staff, seq FROM (SELECT *, bool_or(seen) OVER (PARTITION BY page_id) AS any_seen FROM f) WHERE seen OR NOT any_seen""")
def bar2_confirmed_bars(spark, sf):
    bars = _boxes(spark, sf).select("page_id", "staff", "seq", F.col("x0").alias("x"), F.col("y0").alias("top"))
    return marks.confirmed_bars(bars, 10.0).select("page_id", "staff", "seq")


@_query(f"WITH {_BOXES} SELECT page_id, seq, x0 AS x, CASE WHEN staff % 2 = 0 THEN y0 ELSE y1 END AS y FROM boxes")
def bem1_stem_ends(spark, sf):
    direction = F.when(F.col("staff") % 2 == 0, "up").otherwise("down")
    return _boxes(spark, sf).select("page_id", "seq", F.col("x0").alias("x"), marks.stem_end(direction, F.col("y0"), F.col("y1")).alias("y"))


@_query(f"""WITH {_INK}, l AS (SELECT page_id, CAST(k AS INTEGER) AS line, 2 + 3 * k AS x0, 10 + 5 * k AS y0, 42 + 3 * k AS x1, 20 + 3 * k AS y1 FROM (SELECT DISTINCT page_id FROM ink), range(0, 6) t(k)),
a AS (SELECT *, unnest(range(x0 + 3, x1 - 3 + 1)) AS x FROM l), c AS (SELECT page_id, line, x, CAST(round_even(y0 + (y1 - y0) * ((x - x0) / 40.0), 0) AS INTEGER) + d AS y FROM a, range(-2, 3) t(d)),
n AS (SELECT c.page_id, line, c.x, count(i.x) AS black, count(*) AS total FROM c LEFT JOIN ink i ON c.page_id = i.page_id AND c.x = i.x AND c.y = i.y GROUP BY ALL)
SELECT page_id, line, round(avg(CAST(black > 0 AS INT)), 6) AS hit_ratio, round(sum(black) / sum(total), 6) AS density FROM n GROUP BY page_id, line""")
def bem2_corridors(spark, sf):
    ink = _ink(spark, sf)
    k = F.col("line")
    lines = ink.select("page_id").distinct().withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(5))))
    lines = lines.select("page_id", "line", (2 + 3 * k).alias("x0"), (10 + 5 * k).alias("y0"), (42 + 3 * k).alias("x1"), (20 + 3 * k).alias("y1"))
    return marks.corridor(ink, lines, 2).select("page_id", "line", F.round("hit_ratio", 6).alias("hit_ratio"), F.round("density", 6).alias("density"))


_PAIRS = _POINTS + """, rk AS (SELECT *, row_number() OVER (PARTITION BY staff ORDER BY x, seq) AS rn FROM points),
 pairs AS (SELECT a.staff, a.seq AS "left", b.seq AS "right", b.x - a.x AS dx, b.y - a.y AS dy FROM rk a JOIN rk b ON a.staff = b.staff AND b.rn BETWEEN a.rn + 1 AND a.rn + 4 WHERE b.x - a.x BETWEEN 3600 AND 86400 AND abs(b.y - a.y) <= 50)"""


def _stem_pairs(spark, sf):
    return marks.stem_pairs(_points(spark, sf), ["staff"], 3600, 86400, 50, 0.85)


@_query(f"""WITH {_PAIRS} SELECT staff, "left", "right", round(dx, 3) AS dx, round(dy, 6) AS dy FROM pairs""")
def bem3_stem_pairs(spark, sf):
    return _stem_pairs(spark, sf).select("staff", "left", "right", F.round("dx", 3).alias("dx"), F.round("dy", 6).alias("dy"))


#: Stems of the events: x in tenths of an hour, y the value; a space is ten hours.
_LINKS = """stems AS (SELECT user_id AS staff, CASE WHEN event_type IN ('click', 'view') THEN 'up' ELSE 'down' END AS direction, event_id AS seq, CAST(floor(epoch_us(ts) / 3.6e8) AS BIGINT) AS x, CAST(floor(value) AS BIGINT) AS y FROM events),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY staff, direction ORDER BY x, seq) AS rn FROM stems),
 pairs AS (SELECT a.staff, a.direction, a.seq AS "left", b.seq AS "right", b.rn - a.rn AS gap, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, b.x - a.x AS dx, b.y - a.y AS dy FROM ranked a JOIN ranked b ON a.staff = b.staff AND a.direction = b.direction AND b.rn BETWEEN a.rn + 1 AND a.rn + 4
   WHERE b.x - a.x BETWEEN 110 AND 750 AND abs(b.y - a.y) <= 260 AND abs((b.y - a.y) / greatest(1, b.x - a.x)) <= 0.85),
 felt AS (SELECT *, round(1 - abs(dy) / 260.0::DOUBLE, 6) AS hit_ratio, round(0.5::DOUBLE * (1 - dx / 1500.0::DOUBLE), 6) AS density FROM pairs),
 scored AS (SELECT *, round(least(1.0::DOUBLE, 0.72::DOUBLE * hit_ratio + 0.55::DOUBLE * density), 6) AS score FROM felt), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY staff, direction, "left" ORDER BY score DESC, gap) = 1),
 ordered AS (SELECT *, row_number() OVER (PARTITION BY staff, direction ORDER BY x0, "left") AS seq FROM best)"""
_SUPPRESSED = _fold_sql("staff, direction", "ordered", "abs(i[1].x0 - k.x0) <= 45 AND abs(i[1].x1 - k.x1) <= 45", _LINKS).removeprefix("WITH ").replace("SELECT staff, direction, k.seq AS seq FROM kept", "")
_PATHS = f"""{_SUPPRESSED}, links AS (SELECT k.* FROM kept),
 good AS (SELECT *, round(score - (0.14::DOUBLE * (gap - 1) + 0.015::DOUBLE * greatest(0.0::DOUBLE, greatest(1, x1 - x0) / 100.0::DOUBLE - 2.8::DOUBLE)), 6) AS quality, round((y1 - y0) / CAST(greatest(1, x1 - x0) AS DOUBLE), 6) AS slope FROM links WHERE gap <= 2 AND greatest(1, x1 - x0) <= 480 AND abs((y1 - y0) / greatest(1, x1 - x0)) <= 0.75),
 out_ AS (SELECT * FROM good WHERE quality >= 0.58 QUALIFY row_number() OVER (PARTITION BY staff, direction, "left" ORDER BY quality DESC, x0, "left", x1) = 1),
 chosen AS (SELECT * FROM out_ QUALIFY row_number() OVER (PARTITION BY staff, direction, "right" ORDER BY quality DESC, x0, "left", x1) = 1),
 paths AS (SELECT c.*, c."left" AS path, 0 AS place FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM chosen p WHERE p.staff = c.staff AND p.direction = c.direction AND p."right" = c."left")
   UNION ALL SELECT c.*, w.path, w.place + 1 FROM paths w JOIN chosen c ON c.staff = w.staff AND c.direction = w.direction AND c."left" = w."right"),
 walk AS (SELECT staff, direction, path, place, 0 AS segment, [slope] AS s FROM paths WHERE place = 0 UNION ALL
   SELECT p.staff, p.direction, p.path, p.place, CASE WHEN abs(p.slope - list_median(w.s)) > 0.22 THEN w.segment + 1 ELSE w.segment END, CASE WHEN abs(p.slope - list_median(w.s)) > 0.22 THEN [p.slope] ELSE list_append(w.s, p.slope) END
   FROM walk w JOIN paths p ON p.staff = w.staff AND p.direction = w.direction AND p.path = w.path AND p.place = w.place + 1),
 split AS (SELECT p.*, w.segment FROM paths p JOIN walk w USING (staff, direction, path, place))"""
_STAFF = ["staff", "direction"]


def _scored_links(spark, sf):
    """Each left end's best link of the next four, suppressed by both ends."""
    direction = F.when(F.col("kind").isin("click", "view"), "up").otherwise("down")
    x = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e8)
    events = adapters.table(spark, sf, "events")
    stems = events.select(F.col("user_id").alias("staff"), F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), x.alias("x"), F.floor("value").alias("y"))
    pairs = marks.stem_pairs(stems.withColumn("direction", direction), _STAFF, 110, 750, 260, 0.85)
    felt = pairs.withColumn("hit_ratio", F.round(1 - F.abs("dy") / 260.0, 6)).withColumn("density", F.round(0.5 * (1 - F.col("dx") / 1500.0), 6))
    felt = felt.withColumn("score", F.round(F.least(F.lit(1.0), 0.72 * F.col("hit_ratio") + 0.55 * F.col("density")), 6))
    first = Window.partitionBy(*_STAFF, "left").orderBy(F.col("score").desc(), "gap")
    best = felt.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    best = best.withColumn("seq", F.row_number().over(Window.partitionBy(*_STAFF).orderBy("x0", "left")).cast("long"))
    return boxes.suppress(best, _STAFF, ["left", "right", "gap", "x0", "y0", "x1", "y1", "hit_ratio", "density"], boxes.ends_conflict(45))


def _paths(spark, sf):
    return beams.label_paths(beams.chosen_links(_scored_links(spark, sf), _STAFF, F.lit(100.0)), _STAFF)


@_query(f"""WITH RECURSIVE {_PATHS} SELECT staff, direction, "left", "right", path, place, quality FROM paths""")
def bem4_beam_paths(spark, sf):
    return _paths(spark, sf).select(*_STAFF, "left", "right", "path", "place", "quality")


@_query(f"""WITH RECURSIVE {_PATHS} SELECT staff, direction, path, segment, count(*) AS links, round(median(slope), 8) AS slope FROM split GROUP BY staff, direction, path, segment""")
def bem5_slope_segments(spark, sf):
    split = beams.split_paths(_paths(spark, sf), _STAFF)
    return split.groupBy(*_STAFF, "path", "segment").agg(F.count("*").alias("links"), F.round(F.median("slope"), 8).alias("slope"))


@_query(f"""WITH RECURSIVE {_PATHS}, g AS (SELECT staff, direction, path, segment, first("left" ORDER BY place) || ',' || string_agg("right", ',' ORDER BY place) AS stems,
 first(x0 ORDER BY place) || ' ' || first(y0 ORDER BY place) || ';' || string_agg(x1 || ' ' || y1, ';' ORDER BY place) AS points,
 least(min(x0), min(x1)) - 35 AS x0, least(first(y0 ORDER BY place), min(y1)) - 35 AS y0, greatest(max(x0), max(x1)) + 35 AS x1, greatest(first(y0 ORDER BY place), max(y1)) + 35 AS y1,
 round(median(slope), 8) AS slope, {", ".join(f"round(sum(CAST(round({c} * 1e6) AS BIGINT)) / count(*) / 1e6, 9) AS {c}" for c in ("score", "hit_ratio", "density"))} FROM split GROUP BY staff, direction, path, segment) SELECT * FROM g""")
def bem6_group_summary(spark, sf):
    groups = beams.beam_groups(beams.split_paths(_paths(spark, sf), _STAFF), _STAFF, F.lit(100.0))
    points = F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["x"], p["y"])), ";")
    groups = groups.withColumn("stems", F.array_join(F.col("stems").cast("array<string>"), ",")).withColumn("points", points)
    return groups.select(*_STAFF, "path", "segment", "stems", "points", "x0", "y0", "x1", "y1", F.round("slope", 8).alias("slope"), *[F.round(c, 9).alias(c) for c in ("score", "hit_ratio", "density")])


# ---------------------------------------------------------- secondary symbols
def _without(spark, sf, near, reach: float, right: str = "x0") -> DataFrame:
    """Even boxes without an odd one near, which stands for a mark from x0 to ``right``."""
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("seq", "x0", "y0", "x1", "y1"))
    own = _boxes(spark, sf).withColumn("id", F.col("seq")).withColumn("seq", order).withColumn("x", F.col("x0"))
    flagged = symbols.flagged(own.where("staff % 2 = 0"), symbols.spans(own.where("staff % 2 = 1"), "x0", right), near, F.lit(reach), "near", ["page_id"])
    return flagged.where("not near").select("page_id", F.col("id").alias("seq"))


def _anti(test: str) -> str:
    return f"WITH {_BOXES} SELECT page_id, seq FROM boxes a WHERE staff % 2 = 0 AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.staff % 2 = 1 AND a.page_id = b.page_id AND ({test}))"


@_query(_anti("abs(b.x0 - (a.x0 + a.x1) * 0.5) <= 4.5"))
def sec1_not_near_bars(spark, sf):
    return _without(spark, sf, lambda a, b: marks.near_bar(a, b, 4.5), 4.5)


@_query(_anti("least(a.x1, b.x1 + 20) >= greatest(a.x0, b.x0 - 20) AND least(a.y1, b.y1 + 20) >= greatest(a.y0, b.y0 - 20)"))
def sec2_not_near_groups(spark, sf):
    return _without(spark, sf, lambda a, b: marks.near_group(a, b, 20), 20, "x1")


_BY_STEM = "b.x0 BETWEEN a.x0 - 7.5 AND a.x1 + 7.5 AND least(b.y1, a.y1 + 8) >= greatest(b.y0, a.y0 - 8) OR abs(b.x0 - (a.x0 + a.x1) * 0.5) <= 4.5 AND (a.y0 + a.y1) * 0.5 BETWEEN b.y0 - 10 AND b.y1 + 10"


@_query(_anti(_BY_STEM))
def sec3_not_near_stems(spark, sf):
    return _without(spark, sf, lambda a, b: marks.near_stem(a, b, 10.0), 7.5)
