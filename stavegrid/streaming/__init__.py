"""Pages that arrive over time."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from stavegrid.plans import pipeline
from stavegrid.sources.images import load_pages


def detect_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Detect each image that comes into ``folder`` once, into a part of ``out``
    for each batch (column ``batch``).

    All stages work page by page, so there is no state and no watermark.  The
    number of files of a batch, and so of the paths the driver handles, is set.
    A batch that is run again after a failure replaces its own part.
    """
    arrivals = spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY").option("maxFilesPerTrigger", files_per_batch).load(folder).select("path")

    def batch(paths, number: int) -> None:
        names = [r.path for r in paths.collect()]  # at most files_per_batch
        if names:
            pipeline.detect(load_pages(spark, names)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
