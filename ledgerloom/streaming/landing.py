"""A landing folder as a stream: document sets are flattened as they arrive; new records once by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.sources.spans import DOCUMENT_SET, spans


def landing_spans(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Spans of every document-set file that lands in the folder."""
    sets = spark.readStream.schema(DOCUMENT_SET).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return spans(sets)


def new_records(stream: DataFrame, time_col: str, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """Each key once; state is dropped when the watermark has passed."""
    return stream.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(keys)


def run_batches(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch plan on every micro-batch and appends its rows; ends when what is there is done."""

    def write(batch: DataFrame, batch_id: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")  # a repeated batch replaces itself

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
