"""Incremental log counts with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.logs import LOG_COUNTS, LogMarks, log_health


def read_log_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New log files below a folder. The file source takes whole new files only, so a run
    writes its own file instead of appending to an old one."""
    return (
        spark.readStream.format("text")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )


def log_health_stream(
    spark: SparkSession, path: str, out: str, checkpoint: str, marks: LogMarks = LogMarks(), max_files: int = 1000
):
    """Count the lines of files added since the last run and stop.

    Each micro-batch overwrites its own ``batch`` folder, so a batch that is replayed after
    a failure is not counted twice. Returns the finished query.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        log_health(batch, marks=marks).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        read_log_stream(spark, path, max_files)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def log_health_total(spark: SparkSession, out: str) -> DataFrame:
    """All batches so far."""
    cols = LOG_COUNTS.values()
    schema = ", ".join(f"{c} bigint" for c in cols)
    rows = spark.read.schema(schema + ", batch int").parquet(out)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in cols])
