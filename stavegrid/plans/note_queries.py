"""Noteheads on rasters made of the embeddings, step by step, with their SQL.

Each page gets two staves whose space goes by the page's number; the SQL counts
pixels under stencils one by one instead of using integral tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavegrid.operators import masks, notes
from stavegrid.operators.durable import cut
from stavegrid.plans.registry import _GRAY, _fold_sql, _gray, _query

#: Gray below which a pixel is ink: high enough for heads among chance dots.
LEVEL = 121


# --------------------------------------------------------------------- inputs
STAVES = """pages AS (SELECT page_id, max(y) + 1 AS height, max(x) + 1 AS width FROM gray GROUP BY page_id),
 staves AS (SELECT page_id, CAST(k AS INTEGER) AS staff, 14.0 + 40 * k AS top, CAST(CASE k WHEN 0 THEN 6 + page_id % 3 ELSE 8 + page_id % 4 END AS DOUBLE) AS space, 2 AS x0, 62 AS x1, 6 AS scan_x0 FROM pages, range(2) t(k))"""
RASTERS = f"""{_GRAY}, {STAVES}, raw AS (SELECT page_id, y, x FROM gray WHERE g < {LEVEL}),
 bands AS (SELECT page_id, CAST(round_even(top + j * space, 0) AS INTEGER) AS c, CAST(greatest(1, round_even(space * 0.10, 0)) AS INTEGER) AS b, CAST(x0 - round_even(space, 0) AS INTEGER) AS bx0, CAST(x1 + round_even(space, 0) AS INTEGER) AS bx1 FROM staves, range(5) t(j)),
 ink AS (SELECT * FROM raw r WHERE NOT EXISTS (SELECT 1 FROM bands b WHERE b.page_id = r.page_id AND r.y BETWEEN c - b AND c + b AND r.x >= bx0 AND r.x < bx1))"""
ROWS = """rws AS (SELECT s.*, height, width, CAST(k AS INTEGER) AS pitch_step, top + k * space / 2 AS pitch_y, CAST(round_even(top + k * space / 2, 0) AS INTEGER) AS y,
  CAST(greatest(5, round_even(space * 0.78, 0)) AS INTEGER) AS rx, CAST(greatest(4, round_even(space * 0.50, 0)) AS INTEGER) AS ry, scan_x0 AS first, CAST(least(width, round_even(x1 - space, 0)) AS INTEGER) AS last FROM staves s JOIN pages USING (page_id), range(-10, 19) t(k))"""


def page_sizes(gray: DataFrame) -> DataFrame:
    return gray.groupBy("page_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def page_staves(pages: DataFrame) -> DataFrame:
    """Two staves a page, of 6 to 8 and of 8 to 11 pixels' space."""
    k = F.col("staff")
    rows = pages.select("page_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("staff"))
    space = F.when(k == 0, 6 + F.col("page_id") % 3).otherwise(8 + F.col("page_id") % 4).cast("double")
    rows = rows.select("page_id", "staff", (14.0 + 40 * k).alias("top"), space.alias("space"), F.lit(2).alias("x0"), F.lit(62).alias("x1"), F.lit(6).alias("scan_x0"))
    return rows.withColumn("bottom", F.col("top") + 4 * F.col("space"))


def staff_lines(staves: DataFrame) -> DataFrame:
    return staves.select("page_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.col("top") + j * F.col("space"))).alias("y"), "x0", "x1", "space")


def rasters(spark, sf, level: int = LEVEL) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Raw ink, ink without staff lines, pages, staves."""
    gray = _gray(spark, sf)
    pages = page_sizes(gray)
    staves = page_staves(pages)
    raw = gray.where(F.col("g") < level).select("page_id", "y", "x")
    return raw, masks.erase_lines(raw, staff_lines(staves)), pages, staves


# ------------------------------------------------------------------- stencils
_CELLS = """cells AS (SELECT rx, ry, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx,
   (dx / CAST(rx AS DOUBLE)) * (dx / CAST(rx AS DOUBLE)) + (dy / CAST(ry AS DOUBLE)) * (dy / CAST(ry AS DOUBLE)) <= 1 AS o,
   (dx / greatest(1.0::DOUBLE, rx * 0.50::DOUBLE)) ** 2 + (dy / greatest(1.0::DOUBLE, ry * 0.48::DOUBLE)) ** 2 <= 1 AS i,
   (dx / (rx * 1.35::DOUBLE)) ** 2 + (dy / (ry * 1.35::DOUBLE)) ** 2 <= 1 AS s, (dx / greatest(1.0::DOUBLE, rx * 0.34::DOUBLE)) ** 2 + (dy / greatest(1.0::DOUBLE, ry * 0.30::DOUBLE)) ** 2 <= 1 AS c
  FROM (SELECT DISTINCT rx, ry FROM rws), range(-70, 71) t(dx), range(-50, 51) u(dy) WHERE abs(dx) <= rx AND abs(dy) <= ry),
 stencil AS (SELECT rx, ry, dy, dx, unnest(list_filter([CASE WHEN o THEN 'outer' END, CASE WHEN i THEN 'inner' END, CASE WHEN s AND NOT o THEN 'surround' END, CASE WHEN c THEN 'core' END,
   CASE WHEN o AND NOT i AND dx <= -0.18 * rx THEN 'left' END, CASE WHEN o AND NOT i AND dx >= 0.18 * rx THEN 'right' END, CASE WHEN o AND NOT i AND dy <= -0.15 * ry THEN 'top' END, CASE WHEN o AND NOT i AND dy >= 0.15 * ry THEN 'bottom' END], lambda p: p IS NOT NULL)) AS part FROM cells)"""


@_query(f"""WITH {_GRAY}, {STAVES}, {ROWS}, {_CELLS}, m AS (SELECT *, dx - row_number() OVER (PARTITION BY rx, ry, part, dy ORDER BY dx) AS k FROM stencil),
spans AS (SELECT rx, ry, part, dy, min(dx) AS x0, max(dx) AS x1 FROM m GROUP BY rx, ry, part, dy, k)
SELECT *, CAST(sum(x1 - x0 + 1) OVER (PARTITION BY rx, ry, part) AS INTEGER) AS area FROM spans""")
def not1_stencils(spark, sf):
    spans = notes.stencil_spans(notes.radii(page_staves(page_sizes(_gray(spark, sf)))))
    return spans.join(notes.stencil_areas(spans), ["rx", "ry", "part"])


# ----------------------------------------------------------------- candidates
_CANDIDATES = """bandrows AS (SELECT *, CAST(greatest(0, round_even(pitch_y - 0.72 * space, 0)) AS INTEGER) AS by0, CAST(least(height, round_even(pitch_y + 0.72 * space, 0) + 1) AS INTEGER) AS by1 FROM rws),
 strip AS (SELECT b.page_id, staff, pitch_step, space, first, last, by0, by1, x, (SELECT count(*) FROM ink i WHERE i.page_id = b.page_id AND i.x = t.x AND i.y >= by0 AND i.y < by1) AS n
   FROM bandrows b, LATERAL (SELECT unnest(range(first, last)) AS x) t WHERE by1 > by0),
 hits AS (SELECT *, CASE WHEN x - lag(x) OVER w <= 2 THEN 0 ELSE 1 END AS new FROM strip WHERE n >= greatest(2, round_even(0.10 * (by1 - by0), 0)) WINDOW w AS (PARTITION BY page_id, staff, pitch_step ORDER BY x)),
 isl AS (SELECT *, sum(new) OVER (PARTITION BY page_id, staff, pitch_step ORDER BY x) AS k FROM hits),
 ruse AS (SELECT page_id, staff, pitch_step, any_value(space) AS space, any_value(first) AS first, any_value(last) AS last, min(x) AS a, max(x) AS b FROM isl GROUP BY page_id, staff, pitch_step, k),
 fit AS (SELECT * FROM ruse WHERE b - a + 1 >= greatest(4, round_even(0.26 * space, 0)) AND b - a + 1 <= round_even(3.2 * space, 0)),
 mid AS (SELECT f.page_id, f.staff, f.pitch_step, f.space, f.first, f.last, round_even(CAST(sum(s.x * n) AS DOUBLE) / sum(n), 0) AS m FROM fit f JOIN strip s ON f.page_id = s.page_id AND f.staff = s.staff AND f.pitch_step = s.pitch_step AND s.x BETWEEN a AND b GROUP BY f.page_id, f.staff, f.pitch_step, f.space, f.first, f.last, f.a),
 cand AS (SELECT page_id, staff, pitch_step, CAST(unnest(range(first, last, CAST(greatest(2, round_even(space / 4, 0)) AS BIGINT))) AS INTEGER) AS x FROM rws
   UNION SELECT page_id, staff, pitch_step, x FROM (SELECT page_id, staff, pitch_step, first, last, CAST(round_even(m + o * space, 0) AS INTEGER) AS x FROM mid, (VALUES (0.0::DOUBLE), (-0.18::DOUBLE), (0.18::DOUBLE)) v(o)) WHERE x >= first AND x < last)"""


def _work(spark, sf):
    """Integral tables are read by several steps, so they are cut here."""
    raw, cleaned, pages, staves = rasters(spark, sf)
    return notes.note_rows(staves, pages), cut(notes.integral_rows(cleaned, pages)), cut(notes.integral_rows(raw, pages)), notes.stencil_spans(notes.radii(staves))


@_query(f"WITH {RASTERS}, {ROWS}, {_CANDIDATES} SELECT * FROM cand")
def not2_candidates(spark, sf):
    raw, cleaned, pages, staves = rasters(spark, sf)
    return notes.candidate_columns(notes.note_rows(staves, pages), notes.integral_rows(cleaned, pages))


# ------------------------------------------------------------- scores and kinds
_SCORES = """seen AS (SELECT c.page_id, c.staff, c.pitch_step, c.x, r.pitch_y AS y, r.space, r.rx, r.ry, r.y AS cy FROM cand c JOIN rws r USING (page_id, staff, pitch_step) WHERE r.y - ry >= 0 AND r.y + ry + 1 <= height AND c.x - rx >= 0 AND c.x + rx + 1 <= width),
 spots AS (SELECT page_id, cy, rx, ry, x FROM seen GROUP BY ALL),
 under AS (SELECT p.page_id, p.cy, p.rx, p.ry, p.x, part, dy, dx, i.x IS NOT NULL AS hit, w.x IS NOT NULL AS rough FROM spots p JOIN stencil s ON s.rx = p.rx AND s.ry = p.ry LEFT JOIN ink i ON i.page_id = p.page_id AND i.y = p.cy + dy AND i.x = p.x + dx LEFT JOIN raw w ON w.page_id = p.page_id AND w.y = p.cy + dy AND w.x = p.x + dx),
 parts AS (SELECT page_id, cy, rx, ry, x, """ + ", ".join(f"count(*) FILTER (WHERE hit AND part = '{p}') / CAST(greatest(1, count(*) FILTER (WHERE part = '{p}')) AS DOUBLE) AS p_{p}" for p in notes.PARTS) + """,
   (count(*) FILTER (WHERE hit AND part = 'outer') - count(*) FILTER (WHERE hit AND part = 'inner')) / CAST(count(*) FILTER (WHERE part = 'outer') - count(*) FILTER (WHERE part = 'inner') AS DOUBLE) AS ring,
   """ + ", ".join(f"count(*) FILTER (WHERE rough AND part = '{p}') / CAST(count(*) FILTER (WHERE part = '{p}') AS DOUBLE) AS w_{p}" for p in ("outer", "inner", "core")) + """ FROM under GROUP BY page_id, cy, rx, ry, x),
 lines_ AS (SELECT page_id, cy, rx, ry, x, count(*) FILTER (WHERE n >= greatest(2, trunc(0.18 * (2 * rx + 1)))) / CAST(2 * ry + 1 AS DOUBLE) AS rowc FROM (SELECT page_id, cy, rx, ry, x, dy, count(*) FILTER (WHERE hit) AS n FROM under WHERE part = 'outer' GROUP BY ALL) GROUP BY page_id, cy, rx, ry, x),
 columns_ AS (SELECT page_id, cy, rx, ry, x, count(*) FILTER (WHERE n >= greatest(2, trunc(0.18 * (2 * ry + 1)))) / CAST(2 * rx + 1 AS DOUBLE) AS colc FROM (SELECT page_id, cy, rx, ry, x, dx, count(*) FILTER (WHERE hit) AS n FROM under WHERE part = 'outer' GROUP BY ALL) GROUP BY page_id, cy, rx, ry, x),
 d AS (SELECT s.page_id, s.staff, s.pitch_step, s.x, s.y, s.space, p.* EXCLUDE (page_id, cy, rx, ry, x), rowc >= 0.30 AND colc >= 0.30 AS covered, p_outer - 0.38 * p_surround AS filled, 0.72 * ring + 0.30 * greatest(0.0, 0.35 - p_inner) - 0.22 * p_surround AS open,
   least(p_left, p_right) / greatest(p_left, p_right, 1e-6) AS balance FROM seen s JOIN parts p USING (page_id, cy, rx, ry, x) JOIN lines_ USING (page_id, cy, rx, ry, x) JOIN columns_ USING (page_id, cy, rx, ry, x)),
 f AS (SELECT *, CASE WHEN covered AND filled >= 0.36 AND p_inner >= 0.30 AND p_left >= 0.20 AND p_right >= 0.20 AND balance >= 0.25 THEN 'filled'
   WHEN covered AND open >= 0.31 AND ring >= 0.31 AND p_inner <= 0.28 AND p_left >= 0.23 AND p_right >= 0.23 AND greatest(p_top, p_bottom) >= 0.18 AND balance >= 0.30 THEN 'open'
   WHEN covered AND filled >= 0.34 AND p_outer >= 0.34 AND p_inner >= 0.30 AND greatest(p_left, p_right) >= 0.20 AND p_surround <= 0.42 AND balance >= 0.24 THEN 'loose' END AS rule,
   w_core >= 0.68 AND w_inner >= 0.58 AND w_outer >= 0.62 AND (w_core - p_core >= 0.42 OR w_inner - p_inner >= 0.42) AS solid,
   0.70 * ring + 0.45 * greatest(0.0, 0.28 - p_core) + 0.30 * greatest(0.0, ring - p_core) AS so, 0.70 * p_core + 0.35 * p_inner + 0.20 * p_outer AS sf FROM d),
 scores AS (SELECT page_id, staff, pitch_step, x, y, space, CASE rule WHEN 'loose' THEN 'filled' ELSE rule END AS first_kind, CASE WHEN rule IS NULL THEN NULL WHEN solid THEN 'filled' WHEN so >= 0.43 AND p_core <= 0.24 AND ring >= 0.31 AND so >= sf * 0.92 THEN 'open' ELSE 'filled' END AS kind,
   CASE WHEN rule = 'open' THEN open WHEN rule IS NOT NULL THEN filled ELSE greatest(filled, open) END AS score, CASE WHEN rule IS NOT NULL AND solid THEN w_outer ELSE p_outer END AS black_density, CASE WHEN rule IS NOT NULL AND solid THEN w_inner ELSE p_inner END AS center_density FROM f)"""
_SCORED = f"{RASTERS}, {ROWS}, {_CANDIDATES}, {_CELLS}, {_SCORES}"


def _scored(spark, sf):
    rows, cleaned, raw, spans = _work(spark, sf)
    counts = notes.stencil_counts(rows, notes.candidate_columns(rows, cleaned), cleaned, raw, spans)
    return notes.scored(counts, rows, notes.stencil_areas(spans))


@_query(f"WITH {_SCORED} SELECT page_id, staff, pitch_step, x, first_kind AS kind, round(score, 9) AS score FROM scores")
def not3_scores(spark, sf):
    return _scored(spark, sf).select("page_id", "staff", "pitch_step", "x", F.col("first_kind").alias("kind"), F.round("score", 9).alias("score"))


@_query(f"WITH {_SCORED} SELECT page_id, staff, pitch_step, x, kind, round(black_density, 9) AS black_density, round(center_density, 9) AS center_density FROM scores WHERE kind IS NOT NULL")
def not4_kinds(spark, sf):
    found = cut(_scored(spark, sf)).where("kind is not null")
    return found.select("page_id", "staff", "pitch_step", "x", "kind", F.round("black_density", 9).alias("black_density"), F.round("center_density", 9).alias("center_density"))


def _near(reach: str) -> str:
    return f"abs(i[1].x - k.x) <= {reach} AND abs(i[1].y - k.y) <= greatest(4.0, 1.10 * {reach})"


_NOTES_IN = _SCORED + """, items AS (SELECT page_id, staff, pitch_step, x, y, kind, score, black_density, center_density, greatest(5, round_even(space * 0.72, 0)) AS reach, CAST(pitch_step AS BIGINT) * 4294967296 + x AS seq FROM scores WHERE kind IS NOT NULL)"""
_BY_ROW = _fold_sql("page_id, staff, pitch_step", "items", _near("k.reach"), _NOTES_IN).replace("SELECT page_id, staff, pitch_step, k.seq AS seq FROM kept", "")
_BY_STAFF = _fold_sql("page_id, staff", "first_kept", _near("8"), "?")
#: Notes that stay after both suppressions.
NOTES = f"""{_BY_ROW.removeprefix("WITH ").replace("listed AS", "listed_rows AS").replace("FROM listed)", "FROM listed_rows)").replace("kept AS", "kept_rows AS")}, first_kept AS (SELECT k.* FROM kept_rows),
 {_BY_STAFF[_BY_STAFF.index("listed AS"):].replace("SELECT page_id, staff, k.seq AS seq FROM kept", "")}, notes AS (SELECT k.* FROM kept)"""


def _notes(spark, sf):
    return notes.kept_notes(_scored(spark, sf))


@_query(f"WITH {NOTES} SELECT page_id, staff, pitch_step, x, round(y, 6) AS y, kind, round(score, 9) AS score FROM notes")
def not5_noteheads(spark, sf):
    return _notes(spark, sf).select("page_id", "staff", "pitch_step", "x", F.round("y", 6).alias("y"), "kind", F.round("score", 9).alias("score"))
