"""Extension: new text shards as a stream into the packed store. The batch engine's expressions are used as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capweave.plans.derive import Plan
from capweave.sources.text import parse


def stream_lines(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """(value, source_path, line_number, file_ord) of shards as they arrive; the number only orders lines of a file."""
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).text(folder)
    return raw.select("value", F.col("_metadata.file_path").alias("source_path"))


def ingest(spark: SparkSession, folder: str, output: str, checkpoint: str, plan: Plan | None = None, available_now: bool = True):
    """Starts the query; each micro-batch is parsed, filtered and appended, clustered by key. A replayed batch replaces itself."""
    plan = plan or Plan()

    def write(batch: DataFrame, number: int) -> None:
        lines = batch.withColumn("line_number", F.monotonically_increasing_id()).withColumn("file_ord", F.lit(0))
        rows = plan.select(parse(lines)).drop("raw", "file_ord", "line_number")
        rows.repartitionByRange("urlkey").sortWithinPartitions("urlkey", "timestamp").write.mode("overwrite").option("compression", "zstd").parquet(f"{output}/batch={number}")

    writer = stream_lines(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Captures by hour and status of a stream with a `timestamp`; state older than the watermark goes."""
    from capweave.functions import values

    t = events.withColumn("at", values.instant(F.col("timestamp")))
    return t.withWatermark("at", late).groupBy(F.window("at", window), "status").agg(F.count("*").alias("captures"))
