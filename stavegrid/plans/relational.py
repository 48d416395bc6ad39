"""Whole pages as relations: from ink and staves to records and documents.

Every step is joins, windows, aggregates and folds keyed by page, or by page and
staff, so the pixels of many pages are spread over all tasks.  What several steps
read is cut.  :mod:`stavegrid.plans.pipeline` does the same work with one page in
one task; its sinks take what :func:`assembled` returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavegrid.functions import half_even
from stavegrid.operators import beams, masks, notes, raster, runs, symbols
from stavegrid.operators import staves as lines_
from stavegrid.operators.durable import cut
from stavegrid.operators.symbols import BOX, KEYS
from stavegrid.params import DEFAULTS as P
from stavegrid.schema import RECORDS



def _s() -> Column:
    return F.col("space")


# ---------------------------------------------------------------------- staves
def ink_of(gray: DataFrame) -> DataFrame:
    """(page_id, y, x): pixels darker than their page's threshold, without specks."""
    kept = masks.drop_specks(runs.ink_runs(raster.binarize(gray)), P.speck_area)
    return kept.select("page_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def found_staves(mask: DataFrame, pages: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(line candidates, staves) of pages of one width.  A staff has its five
    lines' heights as ``lines``, and scans begin right of its clef."""
    rows = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    candidates = cut(lines_.line_candidates(mask, rows, width))
    spaced = candidates.join(lines_.staff_space(candidates).where("space is not null"), "page_id")
    held = lines_.group_staves(spaced)
    a, b = spaced.alias("a"), held.alias("b")
    within = (F.col("a.page_id") == F.col("b.page_id")) & F.col("a.y").between(F.col("b.top"), F.col("b.bottom"))
    own = a.join(b, within).groupBy("b.page_id", "b.staff", "b.top", "b.bottom", "a.space").agg(F.array_sort(F.collect_list("a.y")).alias("lines"), F.median("a.x0").cast("int").alias("x0"), F.median("a.x1").cast("int").alias("x1"))
    return candidates, own.withColumn("scan_x0", F.col("x0") + half_even(P.scan_offset * _s()))


def with_clefs(staves: DataFrame, cleaned: DataFrame, pages: DataFrame) -> DataFrame:
    """``staves`` with their clef's box, its type and the scan begin it pushes on."""
    where = symbols.regions(staves, pages, F.col("x0") - 0.25 * _s(), F.col("x0") + 4.2 * _s(), 3.2)
    parts = symbols.region_parts(runs.ink_runs(cleaned), where)
    found = lines_.clef_boxes(parts, staves)
    found = found.select(*KEYS, *[F.col(c).alias(f"clef_{c}") for c in BOX], "clef_type", F.col("scan_x0").alias("_scan"))
    return staves.join(found, KEYS).withColumn("scan_x0", F.col("_scan")).drop("_scan")


def without_long_runs(cleaned: DataFrame, staves: DataFrame, pages: DataFrame) -> DataFrame:
    """Ink without the long horizontal runs around the staves and a row on both sides."""
    where = symbols.regions(staves, pages, F.col("scan_x0") - 2.0 * _s(), F.col("x1") + _s(), 5.0).alias("g")
    r = runs.ink_runs(cleaned).alias("r")
    inside = (F.col("r.page_id") == F.col("g.page_id")) & (F.col("r.y") >= F.col("ry0")) & (F.col("r.y") < F.col("ry1")) & (F.col("r.x1") >= F.col("rx0")) & (F.col("r.x0") < F.col("rx1"))
    held = r.join(where, inside).select("r.page_id", "r.y", F.greatest("r.x0", "rx0").alias("a"), F.least(F.col("r.x1") + 1, F.col("rx1")).alias("b"), "g.space")
    long = held.where(F.col("b") - F.col("a") >= F.greatest(F.lit(P.long_run_px), half_even(P.long_run * _s())))
    return masks.without(cleaned, long.select("page_id", F.col("a").alias("x0"), (F.col("y") - 1).alias("y0"), F.col("b").alias("x1"), (F.col("y") + 2).alias("y1")))


# -------------------------------------------------------------------- the page
def detect(mask: DataFrame, pages: DataFrame, staves: DataFrame, bar_mask: DataFrame | None = None, clefs: bool = True) -> dict[str, DataFrame]:
    """A table of each record type but line candidates, with the columns that the
    steps need and ``idx``, the record's place on its page.

    ``mask``: ink (page_id, y, x); ``pages``: (page_id, height, width); ``staves``:
    (page_id, staff, top, bottom, space, lines, x0, x1, scan_x0).  ``bar_mask`` is the
    raster that bars are read off, ``mask`` itself by default.
    """
    whole = lambda table, *names: cut(table.select("page_id", *[F.col(n).cast("int") for n in names]))
    mask, pages, staves = whole(mask, "y", "x"), whole(pages, "height", "width"), cut(staves)
    drawn = staves.select("page_id", F.explode("lines").alias("y"), "x0", "x1", "space")
    cleaned = cut(masks.erase_lines(mask, drawn))
    staves = cut(with_clefs(staves, cleaned, pages) if clefs else staves)
    first = cut(symbols.find_text(cleaned, staves, pages))
    accidentals = cut(symbols.find_accidentals(cleaned, staves, pages, first))
    text = cut(symbols.find_text(cleaned, staves, pages, accidentals))
    note_mask = without_long_runs(cleaned, staves, pages)
    for found in (accidentals, text):
        note_mask = masks.without(note_mask, found.select("page_id", *BOX), 2, 2)
    rows, spans = notes.note_rows(staves.select(*KEYS, "top", "space", "x1", "scan_x0"), pages), notes.stencil_spans(notes.radii(staves))
    integral, raw = cut(notes.integral_rows(cut(note_mask), pages)), cut(notes.integral_rows(mask, pages))
    counts = notes.stencil_counts(rows, notes.candidate_columns(rows, integral), integral, raw, spans)
    heads = _placed(notes.kept_notes(notes.scored(counts, rows, notes.stencil_areas(spans))), "staff", "x", "y")
    heads = cut(heads.join(staves.select(*KEYS, "space"), KEYS).withColumn("note", F.col("idx")))
    stems = _placed(symbols.find_stems(cleaned, heads.select("page_id", "note", "staff", "x", "y", "space"), pages), "note")
    stems = cut(stems.withColumn("stem", F.col("idx")))
    ledgers = symbols.find_ledgers(mask, heads.select("page_id", "note", "staff", "x", "y", "space"), staves, pages)
    bars = cut(symbols.find_bars(mask if bar_mask is None else bar_mask, staves, pages))
    links = cut(_placed(symbols.find_links(cleaned, stems, pages), "staff", "x0", "x1", "y0"))
    ways = ["page_id", "staff", "direction", "space"]
    named = links.select(*ways, "left", F.col("idx").alias("link"))
    split = beams.split_paths(beams.label_paths(beams.chosen_links(links, ways, _s()), ways), ways)
    listed = split.join(named, [*ways, "left"]).groupBy(*ways, "path", "segment").agg(F.array_sort(F.collect_list(F.struct("place", "link"))).alias("l")).select(*ways, "path", "segment", F.col("l.link").alias("links"))
    groups = beams.beam_groups(split, ways, _s()).join(listed, [*ways, "path", "segment"])
    started = stems.select("page_id", F.col("stem").alias("path"), F.col("x").alias("start_x"))
    groups = cut(_placed(groups.join(started, ["page_id", "path"]).withColumn("downwards", F.col("direction") == "down"), "staff", "downwards", "start_x", "path", "segment"))
    rx, ry = F.greatest(F.lit(5), half_even(0.95 * _s())), F.greatest(F.lit(4), half_even(0.65 * _s()))
    erased = heads.select("page_id", F.col("x").alias("cx"), half_even(F.col("y")).alias("cy"), rx.cast("double").alias("rx"), ry.cast("double").alias("ry"))
    pruned = cut(masks.erase_marks(cleaned, erased, stems.select("page_id", "x", "y0", "y1")))
    others = cut(symbols.find_symbols(pruned, staves, pages, bars, groups, stems, heads))
    out = {
        "staves": _placed(staves, "staff"), "accidentals": _placed(accidentals, "staff", "x0", "y0"), "text_regions": _placed(text, "staff", "y0", "x0"),
        "noteheads": heads, "stems": stems, "ledger_lines": _placed(ledgers, "staff", "note", "line_number"), "barlines": _placed(bars, "staff", "x"),
        "beam_links": links, "beam_groups": groups,
    }
    return out | {name: _placed(others.where(F.col("family") == name), "staff", "x0", "y0") for name in ("rests", "beams", "slurs_or_ties")}


def _placed(table: DataFrame, *order: str) -> DataFrame:
    return table.withColumn("idx", F.row_number().over(Window.partitionBy("page_id").orderBy(*order)) - 1)


# ------------------------------------------------------------------- documents
def _box(*names: str) -> Column:
    return F.array(*[F.col(n).cast("int") for n in names or BOX])


def _fields(name: str) -> dict[str, Column]:
    """How a record's fields are read off its table where they are not columns of it."""
    return {
        "staves": {"index": F.col("staff"), "y0": F.col("top"), "y1": F.col("bottom")},
        "text_regions": {"bbox": _box(), "text": F.lit("text"), "component_count": F.col("n")},
        "stems": {"note_index": F.col("note")},
        "ledger_lines": {"bbox": _box(), "note_index": F.col("note")},
        "beam_links": {"stem_indices": F.array(F.col("left").cast("int"), F.col("right").cast("int"))},
        "beam_groups": {"bbox": _box(), "stem_indices": F.col("stems").cast("array<int>"), "link_indices": F.col("links").cast("array<int>"), "points": F.transform("points", lambda p: F.array(p["x"].cast("int"), p["y"].cast("int")))},
    }.get(name, {"bbox": _box()} if name in ("accidentals", "rests", "beams", "slurs_or_ties") else {})


def record_table(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """(page_id, idx, fields) of one record type, with the fields of its schema."""
    table = tables[name]
    fields = _fields(name)
    if name == "staves" and "clef_x0" in table.columns:
        fields["clef_bbox"] = F.when(F.col("clef_x0").isNotNull(), _box(*[f"clef_{c}" for c in BOX]))
    elif name == "staves":
        fields |= {"clef_bbox": F.lit(None), "clef_type": F.when(F.col("staff") % 2 == 0, "treble").otherwise("bass")}
    columns = [f.rsplit(" ", 1) for f in RECORDS[name].split(", ")]
    return table.select("page_id", "idx", *[fields.get(n, F.col(n) if n in table.columns else F.lit(None)).cast(t).alias(n) for n, t in columns])


def assembled(tables: dict[str, DataFrame], pages: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """One row a page (schema.PAGE): an array of each record type in order, from the
    tables of :func:`detect`.

    Each table is listed by page on its own and joined to the pages, so a page
    without records of a type has an empty array."""
    space = tables["staves"].groupBy("page_id").agg(F.min("space").alias("staff_space"))
    out = pages.join(space, "page_id", "left")
    if candidates is not None:
        tables = tables | {"staff_line_candidates": candidates.withColumn("idx", F.row_number().over(Window.partitionBy("page_id").orderBy("y")) - 1)}
    for name, ddl in RECORDS.items():
        fields = [f.split(" ")[0] for f in ddl.split(", ")]
        if name not in tables:
            out = out.withColumn(name, F.expr(f"cast(array() as array<struct<{_struct(ddl)}>>)"))
            continue
        listed = record_table(tables, name).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.struct(*fields).alias("r")))).alias("l"))
        out = out.join(cut(listed.select("page_id", F.col("l.r").alias(name))), "page_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.expr(f"cast(array() as array<struct<{_struct(ddl)}>>)")))
    status = F.when(F.col("staff_space").isNull(), "no staff spacing").otherwise("ok")
    return out.select(F.col("page_id").cast("string").alias("page_id"), status.alias("status"), F.col("threshold").cast("int").alias("threshold"), "staff_space", "width", "height", *RECORDS)


def _struct(ddl: str) -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in ddl.split(", "))
