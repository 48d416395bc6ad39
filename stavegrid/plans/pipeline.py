"""Pages to detections, tables, documents and drawing commands."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavegrid.operators.page import PageDetector
from stavegrid.params import DEFAULTS, Params
from stavegrid.schema import PAGE, RECORDS
from stavegrid.sources.images import luma


def detect(pages: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One row for each page (schema.PAGE) with an array of each record type.

    Pages are independent, so there is no shuffle.  A page without staff lines
    says so in ``status`` and has no further records.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for page in frame.itertuples(index=False):
                found = PageDetector(luma(page.data, page.height, page.width, page.channels), params).run()
                row = {"page_id": page.page_id, "status": found.status, "threshold": found.threshold, "staff_space": found.space, "width": page.width, "height": page.height}
                yield pd.DataFrame([row | {name: found.records.get(name, []) for name in RECORDS}])

    return pages.mapInPandas(run, PAGE)


def records(detected: DataFrame, name: str) -> DataFrame:
    """(page_id, idx, fields) of one record type, in document order."""
    return detected.select("page_id", F.posexplode(name).alias("idx", "r")).select("page_id", "idx", "r.*")


def _counts() -> Column:
    def of(kind: str) -> Column:
        return F.size(F.filter("noteheads", lambda n: n["kind"] == kind)).alias(f"{kind}_noteheads")

    kinds = [of("filled"), of("open")]
    return F.struct(*[F.size(name).alias(name) for name in RECORDS], *kinds)


def summary(detected: DataFrame) -> DataFrame:
    """page_id, status, threshold, staff_space (three digits) and the counts."""
    return detected.select("page_id", "status", "threshold", F.round("staff_space", 3).alias("staff_space"), _counts().alias("c")).select("page_id", "status", "threshold", "staff_space", "c.*")


def documents(detected: DataFrame) -> DataFrame:
    """(page_id, document): the nested result as JSON text, counts last."""
    fields = [F.col("page_id").alias("input"), "threshold", *RECORDS, _counts().alias("counts")]
    return detected.select("page_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"))


def write_documents(detected: DataFrame, folder: str) -> None:
    """One JSON file per page, indented, through Spark's text writer."""
    pretty = F.pandas_udf(lambda s: s.map(lambda d: json.dumps(json.loads(d), ensure_ascii=False, indent=2)), "string")
    documents(detected).select("page_id", pretty("document").alias("value")).write.partitionBy("page_id").text(folder)



def _command(layer: str, z: int, shape: str, coords: list, rgba: tuple, width: Column | int = 1, label: Column | None = None) -> list[Column]:
    return [
        F.col("page_id"), F.lit(layer).alias("layer"), F.lit(z).alias("z"), F.lit(shape).alias("shape"),
        F.array(*[c.cast("double") if isinstance(c, Column) else F.lit(float(c)) for c in coords]).alias("coords"),
        F.array(*map(F.lit, rgba)).alias("rgba"), (width if isinstance(width, Column) else F.lit(width)).cast("int").alias("width"), (F.lit(None).cast("string") if label is None else label).alias("label"),
    ]


#: Red, green, blue and opacity of each layer.
COLORS = {"staves": (40, 90, 220, 160), "accidentals": (150, 60, 200, 200), "text_regions": (90, 90, 90, 180), "noteheads": (220, 40, 40, 200), "stems": (20, 150, 60, 200), "ledger_lines": (230, 140, 20, 200), "barlines": (0, 160, 170, 200), "rests": (180, 120, 0, 200), "beams": (110, 70, 20, 200), "beam_links": (60, 180, 200, 160), "beam_groups": (0, 110, 40, 220), "slurs_or_ties": (200, 60, 150, 200)}


def overlay(detected: DataFrame) -> DataFrame:
    """Drawing commands that mark each record on its page, bottom layer first."""
    parts = []
    for z, (name, rgba) in enumerate(COLORS.items()):
        r = records(detected, name)
        if name == "staves":
            lines = r.select("page_id", "x0", "x1", F.explode("lines").alias("y"))
            parts.append(lines.select(*_command(name, z, "line", [F.col("x0"), F.col("y"), F.col("x1"), F.col("y")], rgba)))
            boxed = r.where("clef_bbox is not null").withColumn("b", F.col("clef_bbox"))
            parts.append(boxed.select(*_command(name, z, "box", [F.col("b")[k] for k in range(4)], rgba, 2, F.col("clef_type"))))
        elif name == "noteheads":
            parts.append(r.select(*_command(name, z, "circle", [F.col("x"), F.col("y"), F.lit(6)], rgba, 2, F.col("kind"))))
        elif name in ("stems", "barlines"):
            parts.append(r.select(*_command(name, z, "line", [F.col("x"), F.col("y0"), F.col("x"), F.col("y1")], rgba, 2)))
        elif name == "beam_links":
            parts.append(r.select(*_command(name, z, "line", [F.col(c) for c in ("x0", "y0", "x1", "y1")], rgba, 2)))
        elif name == "beam_groups":
            flat = F.flatten(F.transform("points", lambda p: F.transform(p, lambda v: v.cast("double"))))
            line = r.select(*_command(name, z, "polyline", [0], rgba, 4))
            parts.append(r.withColumn("_f", flat).select(*[F.col("_f").alias("coords") if c == "coords" else e for c, e in zip(line.columns, _command(name, z, "polyline", [0], rgba, 4))]))
        else:
            text = F.col("text") if name == "text_regions" else F.col("side") if name == "ledger_lines" else F.col("kind")
            parts.append(r.select(*_command(name, z, "box", [F.col("bbox")[k] for k in range(4)], rgba, 2, text)))
    return _union(parts)


def notehead_regions(detected: DataFrame) -> DataFrame:
    """Ellipses of the parts that a note was scored by, with labels idx:kind:score
    that alternate above and below."""
    spaced = detected.select("page_id", F.col("staff_space").alias("s"))
    n = records(detected, "noteheads").join(spaced, "page_id")
    rx, ry = F.greatest(F.lit(5), F.rint(F.col("s") * 0.78)), F.greatest(F.lit(4), F.rint(F.col("s") * 0.50))
    parts = []
    for z, (name, a, b, rgba) in enumerate((("surround", 1.35, 1.35, (60, 120, 230, 90)), ("outer", 1.0, 1.0, (230, 60, 60, 150)), ("inner", 0.50, 0.48, (30, 160, 70, 170)))):
        parts.append(n.select(*_command(name, z, "ellipse", [F.col("x"), F.col("y"), rx * a, ry * b], rgba)))
    label = F.format_string("%d:%s:%.2f", F.col("idx"), F.col("kind"), F.col("score"))
    above = F.when(F.col("idx") % 2 == 0, -1.6).otherwise(1.2)
    parts.append(n.select(*_command("label", 3, "text", [F.col("x"), F.col("y") + above * F.col("s")], (0, 0, 0, 255), 1, label)))
    return _union(parts)


def reconstruction(detected: DataFrame) -> DataFrame:
    """Drawing commands that set the page anew from its records: staves, clefs,
    bars, notes with the last stem that names them, ledgers, beams and signs."""
    black = (0, 0, 0, 255)
    st = records(detected, "staves")
    parts = [st.select("page_id", "x0", "x1", F.explode("lines").alias("y")).select(*_command("staff", 0, "line", [F.col("x0"), F.col("y"), F.col("x1"), F.col("y")], black, 2))]
    sign = F.when(F.col("clef_type") == "treble", "\U0001d11e").otherwise("\U0001d122")  # musical symbols of the two clefs
    parts.append(st.select(*_command("clef", 1, "text", [F.col("x0") + F.col("space"), F.col("y0")], black, 1, sign)))
    parts.append(records(detected, "barlines").select(*_command("bar", 1, "line", [F.col("x"), F.col("y0"), F.col("x"), F.col("y1")], black, 2)))
    last = records(detected, "stems").groupBy("page_id", F.col("note_index").alias("idx")).agg(F.max_by(F.struct("x", "y0", "y1"), "idx").alias("stem"))
    notes = records(detected, "noteheads").join(last, ["page_id", "idx"], "left")
    parts.append(notes.select(*_command("note", 2, "ellipse", [F.col("x"), F.col("y"), F.lit(8), F.lit(6)], black, F.when(F.col("kind") == "open", 2).otherwise(0))))
    parts.append(notes.where("stem is not null").select(*_command("stem", 2, "line", [F.col("stem.x"), F.col("y"), F.col("stem.x"), F.when(F.col("stem.y0") < F.col("y"), F.col("stem.y0")).otherwise(F.col("stem.y1"))], black, 2)))
    for name, z in (("ledger_lines", 2), ("rests", 3), ("accidentals", 3), ("slurs_or_ties", 3), ("beams", 3), ("text_regions", 4)):
        r = records(detected, name)
        label = F.col("text") if name == "text_regions" else F.lit(None).cast("string") if name == "ledger_lines" else F.col("kind")
        parts.append(r.select(*_command(name, z, "box", [F.col("bbox")[k] for k in range(4)], black, 1, label)))
    groups = records(detected, "beam_groups")
    segments = groups.select("page_id", F.explode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b"))).alias("s"))
    parts.append(segments.select(*_command("beam", 3, "line", [F.col("s.a")[0], F.col("s.a")[1], F.col("s.b")[0], F.col("s.b")[1]], black, 5)))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out
