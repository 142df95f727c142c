"""Incremental runs: page files in, latest states out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

EVENT = StructType().add("doc_id", "string").add("seq", "long").add("type", "string").add("page", "long").add("total", "long").add("status", "string")


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 20) -> DataFrame:
    """Events appended to a folder as JSON lines."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def fold(events: DataFrame) -> DataFrame:
    """Latest entry and first place of every page; the state is bounded by the pages, so no watermark is needed."""
    entry = F.concat_ws(":", "type", F.coalesce("status", F.lit("")))
    return events.withColumn("entry", entry).groupBy("doc_id", "page").agg(F.max_by("entry", "seq").alias("latest"), F.min("seq").alias("first"), F.max("total").alias("total"))


def run_once(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Folds everything that has come since the last run, writes the pages that changed under path, and stops.

    Each batch is a folder of its own, written again if the batch is repeated; nothing passes through the driver.
    """

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return fold(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, path: str) -> DataFrame:
    """What run_once has written: of every page the state of the last batch that changed it."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.groupBy("doc_id", "page").agg(F.max_by(F.struct("latest", "first", "total"), "batch").alias("s")).select("doc_id", "page", "s.*")


def process_new(pages: DataFrame, step, path: str, checkpoint: str) -> StreamingQuery:
    """Applies step (DataFrame to DataFrame) to pages that have come since the last run and appends the results to path."""
    return step(pages).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
