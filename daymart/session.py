"""Session settings and the shared scratch area."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call-site capture for every column expression slows plan building down
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # yyyyMMdd day partitions are strings; inference would turn them into ints
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def build_session(
    app: str = "daymart",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with this package's settings. Leave ``shuffle_partitions`` unset on a
    cluster whose defaults are sized for it; AQE coalesces small partitions."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(SETTINGS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for stages, taken from ``spark.checkpoint.dir``.

    A machine-local folder is only ever picked in local mode, where driver and
    executors are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_root()


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="spark-daymart-")


class StageArea:
    """Written stages under the shared scratch folder.

    ``save`` writes a frame and reads it back, which cuts lineage, survives executor
    loss and gives the planner the real size. Used between the rounds of iterative jobs.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/daymart/{tag}-{uuid.uuid4().hex[:12]}"
        self._round = 0

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str | None = None) -> DataFrame:
        if name is None:
            name = f"round-{self._round:04d}"
            self._round += 1
        target = self.path(name)
        df.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def save_observed(self, df: DataFrame, name: str | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
        """Save and return aggregates of the written rows, taken while writing."""
        seen = Observation()
        saved = self.save(df.observe(seen, *[m.alias(n) for n, m in metrics.items()]), name)
        return saved, seen.get

    def drop(self, name: str) -> None:
        """Delete one stage that no live frame reads any more."""
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path(name))
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def release(self) -> None:
        """Have the driver collect its garbage: Spark removes the shuffle files of finished jobs only after that, and a
        driver with little to do would keep them, and its heap, for long."""
        gc.collect()
        self.spark._jvm.System.gc()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy row work all task slots when the input is too small to fill them.

    An input of at least one scan split per slot is left alone, so at scale nothing is
    shuffled; below that the shuffle moves less than one split per slot.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(slots, *keys) if size < slots * split else df
