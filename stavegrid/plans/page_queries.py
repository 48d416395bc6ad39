"""Queries over whole pages: the rasters of the embeddings, a hundred vectors a
page, with two staves each, through all steps of :mod:`stavegrid.plans.relational`.

Bars are read off a darker copy, since chance dots leave no unbroken columns.  All
these queries read one detection, which a session writes once for a folder."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavegrid.operators.durable import shared_folder, shuffled_joins
from stavegrid.operators.staves import line_candidates
from stavegrid.plans import note_queries, pipeline, relational
from stavegrid.plans.registry import _gray
from stavegrid.schema import RECORDS

#: Gray below which a pixel counts for bars, and the rasters' width.
BAR_LEVEL, WIDTH = 150, 64


def _detect(spark, sf) -> DataFrame:
    gray = _gray(spark, sf)
    mask, _, pages, staves = note_queries.rasters(spark, sf)
    staves = staves.withColumn("lines", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.col("top") + j * F.col("space")))
    bars = gray.where(F.col("g") < BAR_LEVEL).select("page_id", "y", "x")
    rows = gray.select("page_id", "y").distinct()
    tables = relational.detect(mask, pages, staves, bars, clefs=False)
    return relational.assembled(tables, pages.withColumn("threshold", F.lit(note_queries.LEVEL)), line_candidates(mask, rows, WIDTH))


def _detected(spark, sf) -> DataFrame:
    name = hashlib.sha256(f"{spark.sparkContext.applicationId} {sf}".encode()).hexdigest()[:16]
    path = f"{shared_folder(spark)}/detected-{name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        found = _detect(spark, sf)
        with shuffled_joins(spark):
            found.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _of(name: str):
    def query(spark, sf):
        return pipeline.records(_detected(spark, sf), name)

    return query


def _pictures(spark, sf) -> DataFrame:
    """The gray rasters as pages of bytes."""
    listed = _gray(spark, sf).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "g"))).alias("p"), F.max("y").alias("y"), F.max("x").alias("x"))
    hexed = F.concat_ws("", F.transform("p", lambda c: F.lpad(F.hex(c["g"]), 2, "0")))
    return listed.select(F.col("page_id").cast("string").alias("page_id"), (F.col("y") + 1).alias("height"), (F.col("x") + 1).alias("width"), F.lit(1).alias("channels"), F.unhex(hexed).alias("data"))


def snk1_binary_png(spark, sf):
    """The binarised rasters as PNG bytes."""
    from stavegrid.plans.sinks import binary_png

    return binary_png(_pictures(spark, sf))


def snk7_pdf_documents(spark, sf):
    """Twenty rasters to a PDF."""
    from stavegrid.plans.sinks import pdf_documents

    number = F.col("page_id").cast("long")
    return pdf_documents(_pictures(spark, sf).withColumn("number", number).withColumn("document", F.floor(number / 20)))


def queries() -> dict:
    ids = dict(zip(RECORDS, ("stf1", "stf4", "acc2", "txt7", "not5", "stm1", "led1", "bar1", "sec5_rests", "sec5_beams", "bem3", "bem4", "sec5_slurs")))
    found = {f"page_{ids[name]}_{name}" if not ids[name].startswith("sec5_") else f"page_sec5_{name}": _of(name) for name in RECORDS}
    found |= {
        "drv1_detect": lambda spark, sf: _detected(spark, sf).select("page_id", "status", "threshold", F.round("staff_space", 3).alias("staff_space")),
        "drv2_counts": lambda spark, sf: pipeline.summary(_detected(spark, sf)),
        "snk1_binary_png": snk1_binary_png,
        "snk2_documents": lambda spark, sf: pipeline.documents(_detected(spark, sf)),
        "snk4_overlay": lambda spark, sf: pipeline.overlay(_detected(spark, sf)),
        "snk5_notehead_regions": lambda spark, sf: pipeline.notehead_regions(_detected(spark, sf)),
        "snk7_pdf_documents": snk7_pdf_documents,
        "snk6_reconstruction": lambda spark, sf: pipeline.reconstruction(_detected(spark, sf)),
    }
    return found
