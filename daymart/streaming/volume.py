"""Daily volumes of an event stream, and the check suite that runs on every micro-batch.

The state store holds one count per open day. Days are counted by event time; a row that comes later than the watermark
allows is dropped by Spark and shows in the query's progress.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.days import previous_day
from ..operators import quality
from ..operators.windows import period_change


def volume_stream(events: DataFrame, ts: str, delay: str = "1 hour", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, inc_day, cnt) of a streaming frame; each batch updates the days that it touches.

    Days begin at midnight UTC. Rows are counted on the map side first, so a day with most of the rows is no hot key.
    """
    timed = events.select(*keys, F.col(ts).cast("timestamp").alias("_ts")).withWatermark("_ts", delay)
    counts = timed.groupBy(*keys, F.window("_ts", "1 day").alias("_w")).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select(*keys, F.date_format("_w.start", "yyyyMMdd").alias("inc_day"), "cnt")


def volumes(spark: SparkSession, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, inc_day, cnt) so far: a day's count is the one of the last batch that touched it."""
    rows = spark.read.parquet(f"{out}/volumes")
    return rows.groupBy(*keys, "inc_day").agg(F.max_by("cnt", F.col("batch").cast("int")).alias("cnt"))


def volume_change(day: str, limit: str = ">50%", weight: str = "High") -> quality.Check:
    """The day's count against the day before, from a table of counts."""

    def frame(t) -> DataFrame:
        now = F.sum(F.when(F.col("inc_day") == day, F.col("cnt"))).cast("double")
        before = F.sum(F.when(F.col("inc_day") == previous_day(F.lit(day)), F.col("cnt"))).cast("double")
        return t["volumes"].agg(F.abs(F.try_divide(now - before, before)).alias("measured"))

    return quality.Check("fluctuation", f"volume of {day}", frame=frame, weight=weight, threshold=limit, ratio=True)


def days_out_of_band(last: str, days: int = 7, band: float = 0.3, threshold: str = ">0") -> quality.Check:
    """Number of days up to ``last`` whose count leaves the band around the day before."""

    def frame(t) -> DataFrame:
        low = F.date_format(F.date_sub(F.to_date(F.lit(last), "yyyyMMdd"), days), "yyyyMMdd")
        series = period_change(t["volumes"].where(F.col("inc_day").between(low, F.lit(last))), "inc_day", "cnt")
        return series.agg(F.count_if(F.abs("pct_change") > band * 100).alias("measured"))

    return quality.Check("fluctuation", f"days out of band up to {last}", frame=frame, threshold=threshold)


def daily_checks(newest: str) -> list[quality.Check]:
    return [volume_change(newest), days_out_of_band(newest)]


def run_volume_stream(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    checks: Callable[[str], Sequence[quality.Check]] = daily_checks,
    **trigger,
):
    """Take what the stream holds now (or follow ``trigger``): counts go to ``out``/volumes, check results to ``out``/results.

    ``checks`` makes the suite for the newest day seen. A batch overwrites its own folders and holds whole counts from
    the state store, so a replayed batch counts once.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/volumes/batch={batch_id}")
        # batches after this one are of a run that failed before; a replay must not see them
        so_far = spark.read.parquet(f"{out}/volumes").where(F.col("batch").cast("int") <= batch_id)
        days = so_far.groupBy("inc_day").agg(F.max_by("cnt", F.col("batch").cast("int")).alias("cnt"))
        newest = days.agg(F.max("inc_day")).first()[0]
        if newest is not None:
            quality.run_suite({"volumes": days}, checks(newest)).write.mode("overwrite").parquet(f"{out}/results/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    if not trigger:
        query.awaitTermination()
    return query


def check_results(spark: SparkSession, out: str) -> DataFrame:
    """Results of all batches, with the batch."""
    return spark.read.parquet(f"{out}/results").withColumn("batch", F.col("batch").cast("int"))
