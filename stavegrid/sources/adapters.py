"""Ordinary tables seen as rasters, runs, points and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_PAGE = 100


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` as read, dealt by keys into eight partitions for each split that they
    are read in, so what a task sorts does not grow with the table, however few
    partitions the session shuffles into."""
    return rows.repartition(pieces(rows), *keys)


def pieces(rows: DataFrame) -> int:
    """Eight for each split that ``rows``, as read, are read in."""
    return 8 * max(1, rows.rdd.getNumPartitions())


def gray_raster(embeddings: DataFrame) -> DataFrame:
    """(page_id, y, x, g): a vector is a row of pixels, a hundred rows a page."""
    g = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 1) * 127.5)))
    pixels = embeddings.select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return pixels.select(F.floor(F.col("vec_id") / ROWS_PER_PAGE).cast("long").alias("page_id"), (F.col("vec_id") % ROWS_PER_PAGE).cast("int").alias("y"), "x", g.cast("int").alias("g"))


def text_raster(documents: DataFrame) -> DataFrame:
    """(page_id, y, x) of the visible characters: a document is a page, a line a row."""
    lines = documents.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("y", "line"))
    chars = lines.select("page_id", "y", F.posexplode(F.split("line", "")).alias("x", "c"))
    return chars.where(~F.col("c").isin(" ", "\t", "\r", "")).select("page_id", "y", "x")


def event_points(events: DataFrame) -> DataFrame:
    """(staff, seq, x, y, score, kind): a user is a staff, time runs along x in seconds."""
    x = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.select(F.col("user_id").alias("staff"), F.col("event_id").alias("seq"), x.alias("x"), F.col("value").alias("y"), F.col("value").alias("score"), F.col("event_type").alias("kind"))


def lineitem_boxes(lineitem: DataFrame) -> DataFrame:
    """(page_id, staff, seq, x0, y0, x1, y1, area, score): an item is a box on its supplier's page."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    y0 = F.floor(F.col("l_extendedprice") / 50).cast("int")
    w, h = F.col("l_quantity").cast("int") + 1, F.rint(F.col("l_discount") * 100).cast("int") * 4 + 3
    cols = [F.col("l_suppkey").alias("page_id"), F.col("l_linenumber").cast("int").alias("staff"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), day.alias("x0"), y0.alias("y0")]
    boxes = lineitem.select(*cols, (day + w).alias("x1"), (y0 + h).alias("y1"), (w * h - F.rint(F.col("l_tax") * 100).cast("int")).alias("area"), F.col("l_extendedprice").alias("score"))
    return boxes
