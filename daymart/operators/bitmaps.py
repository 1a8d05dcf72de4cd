"""Distinct entities from mergeable sets: one bitmap per day and bucket, exact and never recounted.

Entities are numbered densely within hash buckets, so no task numbers them all. A bitmap holds 32,768 numbers; sets of
days are merged by OR, so a window of days reads its bitmaps and not their rows, and a new day adds its own bitmaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.days import day_to_date, shift_day

#: hash buckets of a new history; about entities / 32,768 fills the bitmaps best
BUCKETS = 64


def number_entities(df: DataFrame, entity: str, buckets: int = BUCKETS, known: DataFrame | None = None) -> DataFrame:
    """(entity, bucket, no) of the entities that ``known`` lacks; numbers go on after the largest one of the bucket.

    NULL is no entity.
    """
    seen = df.select(F.col(entity).alias("entity")).where("entity IS NOT NULL").distinct()
    if known is not None:
        seen = seen.join(known.select("entity"), "entity", "left_anti")
    seen = seen.withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int"))
    fresh = seen.withColumn("no", F.row_number().over(Window.partitionBy("bucket").orderBy("entity")).cast("bigint"))
    if known is None:
        return fresh
    tops = known.groupBy("bucket").agg(F.max("no").alias("top"))
    return fresh.join(tops, "bucket", "left").select("entity", "bucket", (F.col("no") + F.coalesce("top", F.lit(0))).alias("no"))


def day_bitmaps(df: DataFrame, day: str, entity: str, numbers: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, day, bucket, chunk, bits): the entities of each day. Setting a bit twice changes nothing, so repeated rows
    are merged on the map side and need no distinct."""
    rows = df.select(*keys, day, F.col(entity).alias("entity")).join(numbers, "entity")
    place = rows.select(*keys, day, "bucket", F.bitmap_bucket_number("no").alias("chunk"), F.bitmap_bit_position("no").alias("_bit"))
    return place.groupBy(*keys, day, "bucket", "chunk").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def distinct_between(bitmaps: DataFrame, day: str, lo: str, hi: str, keys: Sequence[str] = (), out: str = "entities") -> DataFrame:
    """Distinct entities of the days from ``lo`` to ``hi``, per key; only these days' bitmaps are read."""
    merged = bitmaps.where(F.col(day).between(lo, hi)).groupBy(*keys, "bucket", "chunk").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias(out))


def distinct_rolling(bitmaps: DataFrame, day: str, n: int = 30, keys: Sequence[str] = (), out: str = "entities") -> DataFrame:
    """Distinct entities of the n days up to each active day.

    A bucket without entities on some day still counts those of the days before, so it gets a row for every active day
    within reach; such rows are numbers, the bitmaps themselves are not copied.
    """
    held = bitmaps.select(*keys, F.unix_date(day_to_date(day)).alias("_d"), "bucket", "chunk", "bits")
    active = held.select(*keys, "_d").distinct()
    reach = held.select(*keys, "bucket", "chunk", F.explode(F.sequence("_d", F.col("_d") + (n - 1))).alias("_d")).distinct()
    rows = reach.join(active, [*keys, "_d"], "left_semi").join(held, [*keys, "_d", "bucket", "chunk"], "left")
    window = Window.partitionBy(*keys, "bucket", "chunk").orderBy("_d").rangeBetween(-(n - 1), 0)
    counts = rows.select(*keys, "_d", F.bitmap_count(F.bitmap_or_agg("bits").over(window)).alias("_n"))
    return counts.groupBy(*keys, "_d").agg(F.sum("_n").cast("bigint").alias(out)).select(*keys, F.date_format(F.date_from_unix_date("_d"), "yyyyMMdd").alias(day), out)


class History:
    """Day bitmaps below a folder that grow by a day at a time.

    ``numbers`` holds the entities' numbers, ``days`` the bitmaps, partitioned by day. Adding a day reads that day's
    rows and the numbers; adding it again replaces its bitmaps, and known entities keep their numbers.
    """

    def __init__(self, spark: SparkSession, path: str, entity_type: str, day: str = "inc_day", buckets: int = BUCKETS):
        self.spark, self.day, self.buckets = spark, day, buckets
        self._numbers, self._days = f"{path}/numbers", f"{path}/days"
        self.schema = f"entity {entity_type}, bucket int, no bigint"
        spark.createDataFrame([], self.schema).write.mode("append").parquet(self._numbers)

    @property
    def numbers(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._numbers)

    @property
    def bitmaps(self) -> DataFrame:
        return self.spark.read.schema(f"bucket int, chunk bigint, bits binary, {self.day} string").parquet(self._days)

    def add(self, df: DataFrame, entity: str) -> None:
        """Add the days of a frame."""
        number_entities(df, entity, self.buckets, self.numbers).write.mode("append").parquet(self._numbers)
        out = day_bitmaps(df, self.day, entity, self.numbers).hint("rebalance", self.day)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.day).parquet(self._days)

    def distinct(self, lo: str, hi: str, out: str = "entities") -> DataFrame:
        return distinct_between(self.bitmaps, self.day, lo, hi, out=out)

    def rolling(self, n: int = 30, since: str | None = None, out: str = "entities") -> DataFrame:
        """Every active day, or those from ``since`` on (the n - 1 days before it are read too)."""
        if since is None:
            return distinct_rolling(self.bitmaps, self.day, n, out=out)
        recent = self.bitmaps.where(F.col(self.day) >= shift_day(since, 1 - n))
        return distinct_rolling(recent, self.day, n, out=out).where(F.col(self.day) >= since)
