"""Raster and PDF outputs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stavegrid.operators.page import PageDetector
from stavegrid.sources.images import luma, png_bytes


def binary_png(pages: DataFrame) -> DataFrame:
    """(page_id, png): ink black on white after despeckling."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for page in frame.itertuples(index=False):
                found = PageDetector(luma(page.data, page.height, page.width, page.channels)).run()
                yield pd.DataFrame({"page_id": [page.page_id], "png": [png_bytes(np.where(found.ink, 0, 255))]})

    return pages.mapInPandas(run, "page_id STRING, png BINARY")


def rasterize(commands: DataFrame, sizes: DataFrame) -> DataFrame:
    """(page_id, png) of drawing commands on white pages (page_id, width, height).
    Text is left out: glyphs need a font."""

    def draw(commands: pd.DataFrame, sizes: pd.DataFrame) -> pd.DataFrame:
        if not len(sizes):
            return pd.DataFrame({"page_id": [], "png": []})
        size = sizes.iloc[0]
        image = np.full((int(size["page_height"]), int(size["page_width"]), 3), 255.0)
        for c in commands.sort_values("z", kind="stable").itertuples(index=False):
            paint(image, c.shape, list(c.coords), tuple(c.rgba), max(1, int(c.width)), int(c.width) == 0)
        return pd.DataFrame({"page_id": [size["page"]], "png": [png_bytes(np.rint(image).astype(np.uint8))]})

    return commands.select(*[commands[c].alias(c) for c in commands.columns]).groupBy("page_id").cogroup(sizes.selectExpr("page_id as page", "width as page_width", "height as page_height").groupBy("page")).applyInPandas(draw, "page_id STRING, png BINARY")


def paint(image: np.ndarray, shape: str, at: list[float], rgba: tuple, width: int, solid: bool = False) -> None:
    """Blend one command into an image of floats."""
    if shape == "polyline":
        for k in range(0, len(at) - 3, 2):
            paint(image, "line", at[k : k + 4], rgba, width)
        return
    if shape == "box":
        x0, y0, x1, y1 = at
        for edge in ((x0, y0, x1, y0), (x0, y1, x1, y1), (x0, y0, x0, y1), (x1, y0, x1, y1)):
            paint(image, "line", list(edge), rgba, width)
        return
    if shape == "text":
        return
    if shape == "circle":
        at = [at[0], at[1], at[2], at[2]]
    reach = width + 1
    if shape == "line":
        (xa, xb), (ya, yb) = sorted((at[0], at[2])), sorted((at[1], at[3]))
    else:
        xa, xb, ya, yb = at[0] - at[2], at[0] + at[2], at[1] - at[3], at[1] + at[3]
    y, x = np.mgrid[max(0, int(ya - reach)) : min(image.shape[0], int(yb + reach) + 1), max(0, int(xa - reach)) : min(image.shape[1], int(xb + reach) + 1)]
    if not y.size:
        return
    if shape == "line":
        dx, dy = at[2] - at[0], at[3] - at[1]
        t = np.clip(((x - at[0]) * dx + (y - at[1]) * dy) / max(1e-9, dx * dx + dy * dy), 0, 1)
        hit = np.hypot(x - at[0] - t * dx, y - at[1] - t * dy) <= width / 2
    else:
        r = np.hypot((x - at[0]) / max(at[2], 1e-9), (y - at[1]) / max(at[3], 1e-9))
        hit = r <= 1 if solid else np.abs(r - 1) * min(at[2], at[3]) <= width / 2 + 0.5
    share = rgba[3] / 255
    part = image[y[0, 0] : y[-1, 0] + 1, x[0, 0] : x[0, -1] + 1]
    part[hit] = part[hit] * (1 - share) + np.array(rgba[:3]) * share


def pdf_bytes(pages: list[np.ndarray]) -> bytes:
    """A PDF with one gray or RGB raster to a page."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    kids = []
    for p in pages:
        h, w = p.shape[:2]
        body, space = zlib.compress(np.ascontiguousarray(p, np.uint8).tobytes()), b"/DeviceGray" if p.ndim == 2 else b"/DeviceRGB"
        n = len(objects) + 1
        draw = b"%d 0 0 %d 0 0 cm /I Do" % (w, h)
        objects.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace %s /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (w, h, space, len(body), body))
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(draw), draw))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Contents %d 0 R /Resources << /XObject << /I %d 0 R >> >> >>" % (w, h, n + 1, n))
        kids.append(n + 2)
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = b"%PDF-1.4\n", []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))


def pdf_documents(pages: DataFrame) -> DataFrame:
    """(document, pages, pdf): a PDF of the pages (PAGES, with ``document`` and
    ``number``) of each document, in the order of their numbers.  A task holds
    one document at a time, as its reader will."""

    def bind(frame: pd.DataFrame) -> pd.DataFrame:
        rasters = [luma(p.data, p.height, p.width, p.channels) for p in frame.sort_values(["number", "page_id"]).itertuples(index=False)]
        return pd.DataFrame({"document": [frame["document"].iloc[0]], "pages": [len(rasters)], "pdf": [pdf_bytes(rasters)]})

    return pages.groupBy("document").applyInPandas(bind, "document LONG, pages LONG, pdf BINARY")


def save_png(pictures: DataFrame, folder: str) -> list[str]:
    """Write (page_id, png) to a folder of the driver, a page at a time.  Pages of
    one file name from different folders get the hash of their whole id as well."""
    named = Window.partitionBy(F.element_at(F.split("page_id", "/"), -1))
    out = []
    for row in pictures.withColumn("alike", F.count("*").over(named)).toLocalIterator():
        name = Path(row.page_id).name + (f"-{zlib.crc32(row.page_id.encode()):08x}" if row.alike > 1 else "")
        path = Path(folder) / (name + ".png")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(bytes(row.png))
        out.append(str(path))
    return out
