"""Training logs as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moru.operators import logs
from moru.session import ensure_checkpoint_dir


def metrics(spark: SparkSession, path: str, watermark: str = "1 hour", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of ``kind, step, loss, lr, tok_s, ppl, path`` from the text files that arrive in ``path``; each step once, lines read again are
    ignored. The state of a step is dropped when the watermark over the files' times passes it."""
    source = spark.readStream.format("text")
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    lines = source.load(path).select(F.col("value").alias("line"), F.col("_metadata.file_modification_time").alias("at"))
    parsed = logs.parse(lines).where("kind is not null").withWatermark("at", watermark)
    return parsed.dropDuplicatesWithinWatermark(["kind", "step", "path"]).drop("line")


def event_windows(events: DataFrame, width: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """``start, event_type, n, total`` of tumbling windows over ``ts``; batch or stream. Rows later than the watermark are dropped in a stream."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def streamed(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows of a stream over what is there now: its batches go to the shared checkpoint folder, the last one alone in ``complete`` mode."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={n}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_available(stream: DataFrame, checkpoint: str, table: str) -> None:
    """Process what is there and stop; the rows are in the memory table ``table``."""
    stream.writeStream.format("memory").queryName(table).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
