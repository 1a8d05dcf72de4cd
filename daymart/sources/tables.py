"""Reading, describing and writing day-partitioned tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.days import shift_day
from ..session import StageArea

FORMATS = ("parquet", "orc", "text")


def load(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One table file or folder."""
    return spark.read.format(fmt).load(f"{folder}/{name}.{fmt}")


def scan(spark: SparkSession, table: str, day_pred: Column) -> DataFrame:
    """Read a catalog table; the day predicate is not optional."""
    if day_pred is None:
        raise ValueError("a day predicate is required")
    return spark.table(table).where(day_pred)


def read_files(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None
) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def write_files(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def describe_table(spark: SparkSession, table: str) -> DataFrame:
    """(column, type, comment, is_partition) of a catalog table."""
    rows = [(c.name, c.dataType, c.description or "", c.isPartition) for c in spark.catalog.listColumns(table)]
    return spark.createDataFrame(rows, "column string, type string, comment string, is_partition boolean")


def list_tables(spark: SparkSession, database: str | None = None, keyword: str = "") -> DataFrame:
    """Catalog tables of a database whose name or comment holds the keyword."""
    word = keyword.lower()
    rows = [
        (".".join(t.namespace or []), t.name, t.description or "")
        for t in spark.catalog.listTables(database)
        if word in t.name.lower() or word in (t.description or "").lower()
    ]
    return spark.createDataFrame(rows, "database string, table_name string, comment string")


def sample_table(df: DataFrame, day_pred: Column, n: int = 10, order: Sequence[Column | str] = ()) -> DataFrame:
    """A few rows of one partition; give an order to make the choice repeatable."""
    rows = df.where(day_pred)
    if order:
        rows = rows.orderBy(*order)
    return rows.limit(n)


def run_sql(spark: SparkSession, sql: str, sources: Mapping[str, DataFrame] | None = None, *, max_rows: int | None) -> DataFrame:
    """Run a statement and hand back at most ``max_rows`` rows, or all of them for None. The caller always says which."""
    rows = spark.sql(sql, **(sources or {}))
    return rows if max_rows is None else rows.limit(max_rows)


# Corpus file kinds and folders never scanned.
CORPUS_SUFFIXES = ("sql", "md", "json")
SKIPPED_FOLDERS = (".git", ".venv", "__pycache__", "node_modules", ".claude", ".tmp", "logs", ".idea", ".pytest_cache")


def scan_corpus(spark: SparkSession, root: str, suffixes: Sequence[str] = CORPUS_SUFFIXES) -> DataFrame:
    """(path, kind, text): one row per script, document or model file below a folder."""
    glob = "*.{" + ",".join(suffixes) + "}"
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    path = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    below = F.regexp_replace(path, "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    inside = F.split(below, "/")
    return (
        files.select(path.alias("path"), F.col("value").alias("text"), F.slice(inside, 1, F.size(inside) - 1).alias("_f"))
        .where(~F.arrays_overlap("_f", F.array(*[F.lit(x) for x in SKIPPED_FOLDERS])))
        .select("path", F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("kind"), "text")
    )


def create_table(
    spark: SparkSession,
    name: str,
    schema: T.StructType,
    partition_by: Sequence[str] = ("inc_day",),
    fmt: str = "parquet",
    comment: str = "",
    location: str | None = None,
) -> None:
    """Partitioned table with column comments taken from the field metadata."""

    def text(value: str) -> str:
        return value.replace("\\", "\\\\").replace("'", "\\'")

    cols = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}"
        + (f" COMMENT '{text(f.metadata['comment'])}'" if f.metadata.get("comment") else "")
        for f in schema.fields
    )
    sql = f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING {fmt}"
    if partition_by:
        sql += f" PARTITIONED BY ({', '.join(partition_by)})"
    if location:
        sql += f" LOCATION '{text(location)}'"
    if comment:
        sql += f" COMMENT '{text(comment)}'"
    spark.sql(sql)


def write_partition(df: DataFrame, table: str, day: str, day_col: str = "inc_day") -> None:
    """Overwrite exactly one day; other days stay."""
    cols = [c for c in df.sparkSession.table(table).columns if c != day_col]
    items = ", ".join(f"`{c}`" for c in cols)
    df.sparkSession.sql(
        f"INSERT OVERWRITE TABLE {table} PARTITION ({day_col} = '{day}') SELECT {items} FROM {{src}}", src=df.select(*cols)
    )


def write_partitions(df: DataFrame, table: str, day_col: str = "inc_day") -> None:
    """Overwrite the days present in the frame; the day is selected last.

    One day may hold a large share of the rows: the rebalance hint lets AQE split such a
    day over several files and merge small ones.
    """
    spark = df.sparkSession
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    cols = [c for c in df.columns if c != day_col]
    out = df.select(*cols, day_col).hint("rebalance", day_col)
    spark.conf.set(mode, "dynamic")
    try:
        out.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, before)


def append(df: DataFrame, table: str, day_col: str = "inc_day") -> None:
    """Add rows, gathered by day first so that tasks do not each write a file per day."""
    out = df.hint("rebalance", day_col) if day_col in df.columns else df
    out.write.insertInto(table, overwrite=False)


def evolve_and_backfill(
    spark: SparkSession,
    table: str,
    new_cols: Mapping[str, str],
    compute: Callable[[DataFrame], DataFrame],
    bizdate: str,
    days: int = 30,
    day_col: str = "inc_day",
) -> None:
    """Add columns and recompute the last ``days`` partitions; older ones read as the default.

    ``new_cols`` maps names to types, which may carry a default (``int DEFAULT 0``); without one they read as NULL.
    ``compute`` gets the rows of those days and returns them with the new columns filled.
    """
    have = set(spark.table(table).columns)
    added = ", ".join(f"`{n}` {t}" for n, t in new_cols.items() if n not in have)
    if added:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({added})")
    recent = spark.table(table).where(F.col(day_col).between(shift_day(bizdate, 1 - days), bizdate))
    filled = compute(recent)
    order = [c for c in spark.table(table).columns if c != day_col]
    # the table cannot be overwritten while it is read: stage the new rows first
    stage = StageArea(spark, "backfill")
    write_partitions(stage.save(filled.select(*order, day_col), "rows"), table, day_col)
    stage.drop("rows")


def stage(df: DataFrame, table: str, location: str | None = None) -> DataFrame:
    """Rebuildable ``tmp_`` stage: replaced on every run, read back as a table."""
    if not table.rsplit(".", 1)[-1].startswith("tmp_"):
        raise ValueError("stage tables start with tmp_")
    writer = df.write.mode("overwrite")
    if location:
        writer = writer.option("path", location)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)
