"""Set operations, version diffs and insert-only merge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines_of, normalised_sha


#: repeats of a row that one array holds
REPEAT_PART = 10_000


def union_like(frames: Sequence[DataFrame], distinct: bool = False) -> DataFrame:
    """UNION ALL by column name, or UNION."""
    out = reduce(lambda a, b: a.unionByName(b), frames)
    return out.distinct() if distinct else out


def line_diff(old: DataFrame, new: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Distinct lines added and removed per document between two versions.

    One join on the document key; lines travel as pairs of 64-bit hashes and are compared inside the row.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        trimmed = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
        hashes = F.transform(lines_of(trimmed), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b")))
        return df.select(key, F.array_distinct(hashes).alias(name))

    empty = F.array().cast("array<struct<a: bigint, b: bigint>>")
    both = side(old, "_o").join(side(new, "_n"), key, "full")
    both = both.select(
        key, F.coalesce("_o", empty).alias("_o"), F.coalesce("_n", empty).alias("_n")
    )
    return both.select(
        key,
        F.size(F.array_except("_n", "_o")).cast("bigint").alias("added_lines"),
        F.size(F.array_except("_o", "_n")).cast("bigint").alias("removed_lines"),
    ).withColumn("total_changed", F.col("added_lines") + F.col("removed_lines"))


def diff_datasets(old: DataFrame, new: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """State of each key between two outputs: same, changed, added, removed or duplicate.

    Equal rows of both sides are counted together first, then per key; both steps are hash
    aggregations on numbers, and NULLs compare equal. A key that repeats within one side
    has no single row to compare and is reported as ``duplicate``; use ``multiset_diff``
    there.
    """

    def side(df: DataFrame, old_row: int) -> DataFrame:
        return df.select(*keys, *cols, F.lit(old_row).alias("_o"), F.lit(1 - old_row).alias("_n"))

    rows = (
        side(old, 1)
        .unionByName(side(new, 0))
        .groupBy(*keys, *cols)
        .agg(F.sum("_o").alias("_o"), F.sum("_n").alias("_n"))
    )
    per_key = rows.groupBy(*keys).agg(
        F.sum("_o").alias("old_rows"),
        F.sum("_n").alias("new_rows"),
        F.max(F.when((F.col("_o") > 0) & (F.col("_n") > 0), 1).otherwise(0)).alias("_equal"),
    )
    state = (
        F.when((F.col("old_rows") > 1) | (F.col("new_rows") > 1), "duplicate")
        .when(F.col("old_rows") == 0, "added")
        .when(F.col("new_rows") == 0, "removed")
        .when(F.col("_equal") == 1, "same")
        .otherwise("changed")
    )
    return per_key.withColumn("state", state).drop("_equal")


def multiset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with different multiplicity, tagged by the side that has more of them, as often as it has more.

    Both sides are counted in one aggregation, so each is read and shuffled once.
    """
    cols = old.columns
    sides = old.withColumn("_count", F.lit(1)).unionByName(new.withColumn("_count", F.lit(-1)))
    more = sides.groupBy(*cols).agg(F.sum("_count").alias("_count")).where("_count <> 0")
    # in parts of bounded size: a hot row makes many short arrays, not one huge one
    whole = F.abs("_count")
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((whole - 1) / REPEAT_PART)))
    more = more.select(*cols, "_count", parts.alias("_part"))
    left = F.least(F.lit(REPEAT_PART).cast("bigint"), F.abs("_count") - F.col("_part") * REPEAT_PART)
    times = F.array_repeat(F.when(F.col("_count") > 0, "old").otherwise("new"), left.cast("int"))
    return more.select(*cols, F.explode(times).alias("side"))


DIGEST_RANGES = 4096


def _range_of(keys: Sequence[str], ranges: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int").alias("_range")


def digests(df: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None, ranges: int = DIGEST_RANGES) -> DataFrame:
    """(_range, rows, a, b): number of rows and two sums of 64-bit row hashes per range of the keys' hash.

    Sums don't depend on the order of rows, so every task sums what it reads and only ``ranges`` rows leave it. Repeated
    rows count as often as they stand there. Keep the digests of an output to compare later ones without reading it.
    """
    names = [*keys, *(cols if cols is not None else [c for c in df.columns if c not in keys])]
    wide = lambda seed: F.xxhash64(F.lit(seed), *names).cast("decimal(20,0)")
    return df.groupBy(_range_of(keys, ranges)).agg(F.count(F.lit(1)).alias("rows"), F.sum(wide(1)).alias("a"), F.sum(wide(2)).alias("b"))


def differing_ranges(old: DataFrame, new: DataFrame) -> DataFrame:
    """The ranges whose digests differ, from two results of ``digests``."""
    sides = old.select("*", F.lit(1).alias("_s")).unionByName(new.select("*", F.lit(-1).alias("_s")))
    pick = lambda c: F.sum(F.col(c) * F.col("_s"))
    return sides.groupBy("_range").agg(*[pick(c).alias(c) for c in ("rows", "a", "b")]).where("rows <> 0 OR a <> 0 OR b <> 0").select("_range")


def diff_by_digest(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    ranges: int = DIGEST_RANGES,
    old_digests: DataFrame | None = None,
) -> DataFrame:
    """(columns, old_rows, new_rows): rows whose number differs between two outputs, with their numbers.

    Both sides are reduced to digests first; rows are only compared in the ranges of keys whose digests differ. Equal
    outputs cost one pass and no shuffle of rows, and one changed key costs the rows of its range. Rows are told apart by two 64-bit hash sums
    per range. Ranges may differ in size, as one key's rows stand in one range.
    """
    differ = differing_ranges(digests(old, keys, ranges=ranges) if old_digests is None else old_digests, digests(new, keys, ranges=ranges))

    def side(df: DataFrame, o: int) -> DataFrame:
        rows = df.withColumn("_range", _range_of(keys, ranges)).join(differ, "_range", "left_semi").drop("_range")
        return rows.select(*old.columns, F.lit(o).alias("old_rows"), F.lit(1 - o).alias("new_rows"))

    both = side(old, 1).unionByName(side(new, 0)).groupBy(*old.columns)
    return both.agg(F.sum("old_rows").alias("old_rows"), F.sum("new_rows").alias("new_rows")).where("old_rows <> new_rows")


def merge_insert_only(
    current: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Add rows with new keys, keep current rows as they are.

    Updates that share a key give their first row in ``order``.
    """
    fresh = updates.join(current.select(*keys).distinct(), list(keys), "left_anti")
    w = Window.partitionBy(*keys).orderBy(*order)
    first = fresh.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return current.unionByName(first)


def changed(current: DataFrame, previous: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Keys whose normalised text hash differs from the previous version, or is new."""
    now = current.select(key, normalised_sha(text).alias("hash"))
    before = previous.select(key, normalised_sha(text).alias("_prev"))
    return (
        now.join(before, key, "left")
        .select(key, "hash", (~F.col("hash").eqNullSafe(F.col("_prev"))).alias("changed"))
    )
