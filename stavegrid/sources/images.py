"""Page images: Spark's image source, and a generator of score pages."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "page_id STRING, height INT, width INT, channels INT, data BINARY"


def _first(paths: tuple[str, ...]) -> str:
    path = next((p for p in paths if p), None)
    if path is None:
        raise ValueError("no input path")
    if path.lower().endswith(".pdf"):
        raise ValueError(f"{path}: rasterise PDF pages to images first")
    return path


def load_pages(spark: SparkSession, paths: str | list[str], readable: bool = True) -> DataFrame:
    """Pages (PAGES) of all paths; with ``readable`` false also files that are
    no image, as a row of height -1."""
    image = spark.read.format("image").option("dropInvalid", readable).load(paths).select("image.*")
    return image.select(F.col("origin").alias("page_id"), "height", "width", F.col("nChannels").alias("channels"), "data")


def read_pages(spark: SparkSession, *paths: str) -> DataFrame:
    """Pages (PAGES) of the first path that is given.  A page of a PDF has to be
    rasterised first: no reader for them comes with Spark.  Files that cannot
    be read are left out; :func:`page_status` names them."""
    return load_pages(spark, _first(paths))


def page_status(spark: SparkSession, *paths: str) -> DataFrame:
    """(page_id, readable) of every file of the first path that is given."""
    return load_pages(spark, _first(paths), False).select("page_id", (F.col("height") > 0).alias("readable"))


def luma(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Gray levels of BGR(A) or gray rows: ITU-R 601 weights in 16-bit fixed point."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return pixels[:, :, 0]
    blue, green, red = (pixels[:, :, k].astype(np.uint32) for k in range(3))
    return ((19595 * red + 38470 * green + 7471 * blue + 32768) >> 16).astype(np.uint8)


def png_bytes(pixels: np.ndarray) -> bytes:
    """An 8-bit gray (H, W) or RGB (H, W, 3) PNG."""
    height, width = pixels.shape[:2]
    flat = np.ascontiguousarray(pixels, np.uint8).reshape(height, -1)
    rows = np.concatenate([np.zeros((height, 1), np.uint8), flat], 1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def score_page(seed: int, staves: int = 2, space: int = 12, width: int = 640) -> tuple[np.ndarray, list[dict]]:
    """A gray page with staves, stemmed notes, beams and bars, and its notes'
    (staff, pitch_step, x, kind)."""
    rng = np.random.default_rng(seed)
    top, pitch = 8 * space, 14 * space
    page = np.full((top + staves * pitch, width), 255, np.uint8)
    yy, xx = np.mgrid[: page.shape[0], :width]
    truth = []
    for k in range(staves):
        y0 = top + k * pitch
        for line in range(5):
            page[y0 + line * space : y0 + line * space + 2, 20 : width - 20] = 0
        page[y0 - 2 * space // 2 : y0 + 5 * space, 30 : 30 + 2 * space] = 0  # stands for a clef
        for bar in (width // 2, width - 24):
            page[y0 : y0 + 4 * space + 2, bar : bar + 2] = 0
        xs = np.arange(20 + 8 * space, width - 6 * space, 4 * space)
        xs = xs[np.abs(xs - width // 2) > 2 * space]
        ends = []
        for x in xs:
            step, hollow = int(rng.integers(0, 9)), bool(rng.random() < 0.25)
            y = y0 + 1 + step * space / 2
            head = ((xx - x) / (0.72 * space)) ** 2 + ((yy - y) / (0.47 * space)) ** 2 <= 1
            page[head] = 0
            if hollow:
                page[((xx - x) / (0.42 * space)) ** 2 + ((yy - y) / (0.26 * space)) ** 2 <= 1] = 255
            stem = int(x + 0.68 * space)
            page[int(y - 3.3 * space) : int(y), stem : stem + 2] = 0
            ends.append((stem, int(y - 3.3 * space), hollow))
            truth.append({"staff": k, "pitch_step": step, "x": int(x), "kind": "open" if hollow else "filled"})
        for (ax, ay, ah), (bx, by, bh) in zip(ends[::2], ends[1::2]):
            if not ah and not bh and bx - ax <= 5 * space:
                for x in range(ax, bx + 1):
                    y = int(ay + (by - ay) * (x - ax) / (bx - ax))
                    page[y : y + space // 2, x] = 0
    return page, truth


def score_pages(spark: SparkSession, pages: int, **shape) -> DataFrame:
    """Generated pages (PAGES), one seed each."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for seed in frame["id"]:
                page, _ = score_page(int(seed), **shape)
                yield pd.DataFrame({"page_id": [f"page-{seed}"], "height": [page.shape[0]], "width": [page.shape[1]], "channels": [1], "data": [page.tobytes()]})

    return spark.range(0, pages, 1, max(1, min(pages, 64))).mapInPandas(draw, PAGES)
