"""Micro-batch forms: documents arrive as files, findings leave as tables.

Extractors are stateless per document, so each micro-batch runs the same plan as a batch; a batch's output goes to a
folder of its own number and is overwritten if the batch is repeated, so a restart neither loses nor doubles rows.
``first_seen`` keeps one row per key within a watermark, so its state is bounded by the delay, not by the stream; it is
for streams whose rows all have an event time. ``write_first_seen`` keeps one row per key for good: what was seen is
the table written so far, so no state is held, no row is too late, and a null event time is like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def document_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """Files of documents in the order in which they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_findings(stream: DataFrame, families: dict[str, Callable[[DataFrame], DataFrame]], root: str, checkpoint: str) -> StreamingQuery:
    """Runs every extractor over each micro-batch and writes ``root/<family>/batch=<n>``; ends when the input is read."""

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        try:
            for name, extract in families.items():
                extract(df).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, keys: list[str], event_time: str, delay: str = "30 days") -> DataFrame:
    """One row per key; a repetition within ``delay`` of the first is dropped, and so is a row later than that."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a Parquet folder until the input is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def write_first_seen(stream: DataFrame, keys: list[str], root: str, checkpoint: str) -> StreamingQuery:
    """Writes each key once, in the micro-batch that has it first; null keys equal null keys. Ends when the input is read.

    A batch's rows are reduced to one per key and anti-joined with the keys of earlier batches; its folder is
    overwritten if the batch is repeated, so a restart neither loses nor doubles keys.
    """

    def batch(df: DataFrame, number: int) -> None:
        new = df.dropDuplicates(keys)
        if number:
            known = df.sparkSession.read.schema(", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", batch int").parquet(root).where(f"batch < {number}")
            old = known.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).distinct()
            new = new.join(old, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)], "left_anti")
        new.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
