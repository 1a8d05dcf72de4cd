"""Equi-joins. No join hints: AQE sees the run-time sizes, broadcasts what is small and
splits skewed partitions of what is not."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import partitions

CARDINALITIES = ("1:1", "1:N", "N:1", "M:N")


@dataclass(frozen=True)
class JoinSpec:
    """Equi-join between two entities of a model."""

    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]
    how: str = "left"
    cardinality: str = "1:N"

    def __post_init__(self):
        if len(self.left_keys) != len(self.right_keys) or not self.left_keys:
            raise ValueError("a join needs the same number of keys on both sides")
        if self.cardinality not in CARDINALITIES:
            raise ValueError(f"unknown cardinality {self.cardinality!r}")


def _on(left: DataFrame, right: DataFrame, spec: JoinSpec) -> Column:
    return reduce(
        lambda a, b: a & b, [left[x] == right[y] for x, y in zip(spec.left_keys, spec.right_keys)]
    )


def join_rel(left: DataFrame, right: DataFrame, spec: JoinSpec) -> DataFrame:
    """Join along a relationship, keeping both key columns."""
    return left.join(right, _on(left, right, spec), spec.how)


def join_using(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """USING join: equal names, one key column in the output."""
    return left.join(right, list(keys), how)


def full_join(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Chain of full outer joins with one coalesced key.

    Full joins are not split by AQE, so give frames that are already one row per key.
    """
    return reduce(lambda a, b: a.join(b, list(keys), "full"), frames)


def join_dim(
    left: DataFrame, dim: DataFrame, keys: Sequence[str], dim_filter: Column | str | None = None
) -> DataFrame:
    """Left join with a condition on the dimension side, applied before the join."""
    if dim_filter is not None:
        dim = dim.where(dim_filter)
    return left.join(dim, list(keys), "left")


def join_snapshot(left: DataFrame, dim: DataFrame, keys: Sequence[str], day: str = "inc_day") -> DataFrame:
    """Left join to the dimension snapshot of the same day."""
    return left.join(dim, [*keys, day], "left")


def join_bridge(
    a: DataFrame,
    b: DataFrame,
    entity_keys: Sequence[str],
    bridge: DataFrame,
    a_end: tuple[str, str],
    b_end: tuple[str, str],
) -> DataFrame:
    """Match a pair table on both ends against one merged input.

    ``a_end`` and ``b_end`` are (column of the input, column of the bridge).
    """
    merged = a.join(b, list(entity_keys), "left")
    pairs = bridge.withColumnsRenamed({a_end[1]: a_end[0], b_end[1]: b_end[0]})
    return merged.join(pairs, [a_end[0], b_end[0]], "left")


def consecutive(df: DataFrame, entity: str, period: str) -> DataFrame:
    """(entity, period) pairs whose entity was also present one period before."""
    pairs = df.select(entity, period).distinct()
    before = pairs.select(entity, (F.col(period) + 1).alias(period))
    return pairs.join(before, [entity, period], "left_semi")


def orphans(
    child: DataFrame, parent: DataFrame, child_keys: Sequence[str], parent_keys: Sequence[str] | None = None
) -> DataFrame:
    """Child rows without a parent."""
    spec = JoinSpec(tuple(child_keys), tuple(parent_keys or child_keys), "left_anti")
    parents = parent.select(*spec.right_keys).distinct()
    return child.join(parents, _on(child, parents, spec), spec.how)


def in_scope(
    df: DataFrame, dim: DataFrame, keys: Sequence[str], dim_keys: Sequence[str] | None = None
) -> DataFrame:
    """Rows whose key is in the dimension, instead of a hard-coded list."""
    spec = JoinSpec(tuple(keys), tuple(dim_keys or keys), "left_semi")
    wanted = dim.select(*spec.right_keys).distinct()
    return df.join(wanted, _on(df, wanted, spec), spec.how)


def latest_available(
    df: DataFrame,
    bizdate: str,
    day: str = "inc_day",
    cond: Column | str | None = None,
    since: str | None = None,
) -> DataFrame:
    """Rows of the newest day not after the run date; ``cond`` skips days without such rows.

    Where the frame is partitioned by the day, the file index gives the day and no row is read to find it (with
    ``cond`` the newest days are looked at first). Otherwise the day is a scalar subquery. ``since`` bounds the search
    from below.
    """
    known = df.where(F.col(day) <= bizdate)
    if since is not None:
        known = known.where(F.col(day) >= since)
    found = partitions.days(known, day)
    if found is not None:
        newest = (found[0] if found else None) if cond is None else partitions.newest_with(known, found, cond, day)
        return df.where(F.lit(False) if newest is None else F.col(day) == newest)
    if cond is not None:
        known = known.where(cond)
    newest = known.agg(partitions.newest_day(known, day)).scalar()
    return df.where(F.col(day) == newest)


def fanout(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose join multiplies left rows: (keys, left_rows, right_rows, joined_rows).

    Both sides are counted per key first, so no multiplied row is ever made.
    """
    lc = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("left_rows"))
    rc = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("right_rows")).where("right_rows > 1")
    return lc.join(rc, list(keys), "inner").withColumn(
        "joined_rows", F.col("left_rows") * F.col("right_rows")
    )


def has_cross_join(df: DataFrame) -> bool:
    """True when the plan holds a product or nested-loop join (an ON without equality)."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan


def refuse_cross_join(df: DataFrame) -> DataFrame:
    if has_cross_join(df):
        raise ValueError("cross join refused: give an equality between the sides")
    return df


def grid_gaps(
    facts: DataFrame, dims: Sequence[str], day: str, days: DataFrame | None = None
) -> DataFrame:
    """Coverage of a dims x days grid without building it.

    Per dimension tuple: days present, days expected, days missing. Only tuples seen at
    least once are reported; the expected number is one scalar.
    """
    present = facts.select(*dims, day).distinct()
    # the subquery shares the exchange of the distinct tuples
    expected = (days if days is not None else present).agg(F.count_distinct(day)).scalar()
    return (
        present.groupBy(*dims)
        .agg(F.count(F.lit(1)).alias("days_present"))
        .withColumn("days_expected", expected)
        .withColumn("days_missing", F.col("days_expected") - F.col("days_present"))
    )


JoinFn = Callable[[DataFrame, DataFrame], DataFrame]


def chain(df: DataFrame, steps: Iterable[tuple[DataFrame, JoinFn]]) -> DataFrame:
    """Apply joins in order."""
    return reduce(lambda acc, s: s[1](acc, s[0]), steps, df)
