"""The incremental ingest as a Structured Streaming query.

The built-in file stream never reads a file again whose content has changed, which this ingest must; so the
stream only says that something has come, and each micro-batch runs the ingest, whose own manifest decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from ..plans.ingest import IngestResult, run_ingest


_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_stream(spark: SparkSession, json_dir: str, out_dir: str, checkpoint: str, on_result: Callable[[IngestResult], None] | None = None, once: bool = False, interval: str = "1 minute"):
    """Start a query that ingests whenever new files arrive; with once, what is there now, then it ends.

    A batch that is repeated after a failure finds its files in the manifest and changes nothing.
    """

    def batch(_df, _epoch: int) -> None:
        result = run_ingest(spark, json_dir, out_dir)
        if on_result:
            on_result(result)

    arrivals = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.json.gz").load(json_dir).select("path")
    writer = arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
