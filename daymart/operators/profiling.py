"""Table profiling. One long (column, value, cnt) pass feeds null counts, distinct counts,
uniqueness and top values; the hot values of a column are pre-counted before the shuffle."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import partitions
from .joins import latest_available

# Name shapes that steer which columns are profiled.
KEY_SUFFIXES = ("_no", "_id", "_code", "_guid", "_key")
ENUM_MARKERS = ("type", "status", "state", "scene", "flag", "level", "category", "grade")
TIME_MARKERS = ("_tm", "_time", "_date", "_dt", "timestamp")


@dataclass(frozen=True)
class ColumnChoice:
    profile: tuple[str, ...]
    enums: tuple[str, ...]


def choose_columns(schema: T.StructType, mentioned: str = "", limit: int | None = None, enum_limit: int | None = None) -> ColumnChoice:
    """Columns named in a text plus key-like ones; enum candidates are named strings,
    enum-ish names first and time-like names last. All of them, unless limits are given."""
    names = schema.fieldNames()
    named = [n for n in names if re.search(rf"\b{re.escape(n)}\b", mentioned)]
    keyish = [n for n in names if n.endswith(KEY_SUFFIXES) and n not in named]

    def rank(name: str) -> int:
        low = name.lower()
        if any(m in low for m in ENUM_MARKERS):
            return 0
        return 2 if low.endswith(TIME_MARKERS) else 1

    strings = [n for n in named if isinstance(schema[n].dataType, (T.StringType, T.VarcharType, T.CharType))]
    return ColumnChoice(
        tuple((named + keyish)[:limit]),
        tuple(sorted(strings, key=rank)[:enum_limit]),
    )


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, cnt) of several columns in one scan and one shuffle.

    Columns travel as small numbers; counts are combined before the shuffle, so a value
    that fills a column costs one row per task.
    """
    cells = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("value")) for i, c in enumerate(cols)])
        ).alias("cell")
    )
    counts = cells.groupBy("cell.c", "cell.value").agg(F.count(F.lit(1)).alias("cnt"))
    names = F.array(*[F.lit(c) for c in cols])
    return counts.select(F.get(names, F.col("c")).alias("column"), "value", "cnt")


def _column_stats(counts: DataFrame) -> DataFrame:
    # integer sums of per-value counts: the second aggregation is one row per column
    return counts.groupBy("column").agg(
        F.sum("cnt").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
    )


def _note() -> F.Column:
    unique = (F.col("distinct_count") == F.col("row_count")) & (F.col("row_count") > 0)
    return F.when(unique, "unique").otherwise("has duplicates")


def profile_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Row, null and exact distinct counts per column, with the uniqueness note."""
    return _column_stats(value_counts(df, cols)).withColumn("note", _note())


def profile_enums(df: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """Top n values per column; a NULL value counts like any other."""
    w = Window.partitionBy("column").orderBy(F.desc("cnt"), F.asc_nulls_last("value"))
    return value_counts(df, cols).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def latest_partition(
    df: DataFrame, day: str = "inc_day", bounded: bool = False, today: date | None = None
) -> str | None:
    """Newest day. ``bounded`` looks at this year, then last year, then at all before, so an old table is still found.

    Where the frame is partitioned by the day, the file index answers and no row is read; otherwise each look is an
    aggregate over the days that it spans. Only one value reaches the driver.
    """
    column = F.col(day)
    year = (today or date.today()).year
    spans = [(column >= f"{y}0101") & (column < f"{y + 1}0101") for y in (year, year - 1)]
    for rows in [df.where(s) for s in (*spans, column < f"{year - 1}0101")] if bounded else [df]:
        listed = partitions.days(rows, day)
        found = rows.agg(partitions.newest_day(rows, day)).first()[0] if listed is None else listed[0] if listed else None
        if found is not None:
            return found
    return None


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def key_candidates(df: DataFrame, comments: Mapping[str, str] | None = None) -> DataFrame:
    """Primary-key candidates, verified on the data.

    Candidates are columns whose comment calls them a key, else the first ``*_id`` or
    ``*key`` column; ``verified`` means unique and never NULL.
    """
    comments = comments or {}
    named = [f.name for f in df.schema.fields if "key" in (comments.get(f.name) or f.metadata.get("comment", "")).lower()]
    if not named:
        named = [f.name for f in df.schema.fields if f.name.endswith(("_id", "key"))][:1]
    if not named:
        raise ValueError("no key candidate among the columns")
    ok = (F.col("distinct_count") == F.col("row_count")) & (F.col("null_count") == 0)
    return profile_columns(df, named).withColumn("verified", ok)


PROFILE_SCHEMA = (
    "table_name string, column string, row_count bigint, null_count bigint,"
    " distinct_count bigint, note string, error string"
)


def profile_tables(
    tables: Mapping[str, DataFrame | Exception],
    columns: Mapping[str, Sequence[str]] | None = None,
    day: str | None = None,
    bizdate: str | None = None,
) -> DataFrame:
    """Profile many tables now; a table that cannot be analysed or breaks while it is read becomes an error row.

    With ``day`` and ``bizdate`` only the newest partition not after the run date is read.
    """
    parts, errors = {}, []
    spark = next(t.sparkSession for t in tables.values() if isinstance(t, DataFrame))
    names = [c.split()[0] for c in PROFILE_SCHEMA.split(",")]
    for name, df in tables.items():
        try:
            if isinstance(df, Exception):
                raise df
            cols = (columns or {}).get(name) or choose_columns(df.schema).profile
            if day is not None:
                df = latest_available(df, bizdate, day)
            part = profile_columns(df, cols).withColumns({"table_name": F.lit(name), "error": F.lit(None).cast("string")})
            parts[name] = part.select(*names)
        except Exception as e:
            errors.append((name, None, None, None, None, None, type(e).__name__))
    rows: list[tuple] = []  # one per profiled column
    if parts:
        try:
            rows = [tuple(r) for r in reduce(lambda a, b: a.unionByName(b), parts.values()).collect()]
        except PySparkException:  # find the table that broke
            for name, part in parts.items():
                try:
                    rows += [tuple(r) for r in part.collect()]
                except PySparkException as e:
                    errors.append((name, None, None, None, None, None, e.getCondition() or type(e).__name__))
    return spark.createDataFrame([*rows, *errors], PROFILE_SCHEMA)
