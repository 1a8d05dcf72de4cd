"""Compile semantic models to DataFrame expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.days import day_to_date, resolve_macro
from ..functions.exprs import classify, derive
from ..operators.joins import join_rel
from ..operators.windows import dedup_latest
from .model import Chain, DomainModel, FilterRule, Metric

_ALERT = re.compile(r"^\s*(>=|<=|>|<)\s*(-?[\d.]+)\s*%?\s*$")


def compile_metric(model: DomainModel, name: str, params: Mapping[str, str] | None = None) -> Column:
    """One aggregate column for a metric; ``${name}`` parameters become literals."""
    m = model.metrics[name]
    if m.numerator:
        num = compile_metric(model, m.numerator, params).cast("double")
        return F.try_divide(num * m.factor, compile_metric(model, m.denominator, params).cast("double"))
    expression, cond = (_bind(t, params) for t in (m.expression, m.filter))
    return F.expr(f"{expression} FILTER (WHERE {cond})" if cond else expression)


def _bind(text: str, params: Mapping[str, str] | None) -> str:
    for k, v in (params or {}).items():
        text = text.replace("${" + k + "}", v.replace("'", "''"))
    return text


def metric_table(
    df: DataFrame,
    model: DomainModel,
    names: Sequence[str],
    dims: Sequence[str] = (),
    params: Mapping[str, str] | None = None,
    scale: int | None = None,
) -> DataFrame:
    """Many metrics over the same rows in one aggregation, one column each."""
    cols = []
    for n in names:
        c = compile_metric(model, n, params)
        if model.metrics[n].numerator and scale is not None:
            c = F.round(c, scale)
        cols.append(c.alias(n))
    return df.groupBy(*dims).agg(*cols)


def alert_flag(m: Metric, value: Column) -> Column:
    """True when the abnormal-if predicate of the metric holds; False without one."""
    found = _ALERT.match(m.alert or "")
    if not found:
        return F.lit(False)
    op, bound = found.group(1), float(found.group(2))
    test = {">": value > bound, ">=": value >= bound, "<": value < bound, "<=": value <= bound}[op]
    return F.coalesce(test, F.lit(False))


def with_alerts(df: DataFrame, model: DomainModel, names: Sequence[str]) -> DataFrame:
    """Long form (dims, metric, value, unit, alert, level) of a metric table."""
    dims = [c for c in df.columns if c not in names]
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("metric"),
                F.col(n).cast("double").alias("value"),
                F.lit(model.metrics[n].unit).alias("unit"),
                alert_flag(model.metrics[n], F.col(n).cast("double")).alias("alert"),
            )
            for n in names
        ]
    )
    level = F.when(F.col("alert"), "warning").otherwise("normal")
    return df.select(*dims, F.inline(rows)).withColumn("level", level)


def apply_filter_rules(df: DataFrame, rules: Iterable[FilterRule], bizdate: str) -> DataFrame:
    """Partition predicate, conditions and optional de-duplication of each rule, in order."""
    for r in rules:
        for cond in filter(None, (r.partition, *r.conditions)):
            df = df.where(resolve_macro(cond, bizdate))
        if r.dedup_keys:
            df = dedup_latest(df, list(r.dedup_keys), [F.expr(o) if not o.endswith(" desc") else F.desc(o[:-5]) for o in r.dedup_order])
    return df


def classify_by(model: DomainModel, hierarchy: str, default: str | None = None) -> Column:
    return classify(model.hierarchy[hierarchy], default)


def run_chain(df: DataFrame, chain: Chain) -> DataFrame:
    """Composite measure step by step; a step may use the ones before it."""
    return derive(df, dict(chain.steps))


def derived_attribute(df: DataFrame, name: str, rules: Mapping[str, str], allowed: Sequence[str], default: str) -> DataFrame:
    """Computed class with a closed value list and a 0/1 flag for values outside it."""
    out = df.withColumn(name, classify(rules, default))
    return out.withColumn(f"{name}_invalid", F.when(F.col(name).isin(*allowed), 0).otherwise(1))


def join_path(model: DomainModel, frames: Mapping[str, DataFrame], path: Sequence[str]) -> DataFrame:
    """Join entities along the relationships of the model."""
    out = frames[path[0]]
    for left, right in zip(path, path[1:]):
        rel = next(r for r in model.relationships if (r.left, r.right) == (left, right))
        out = join_rel(out, frames[right], rel.spec())
    return out


def churned(df: DataFrame, entity: str, day: str, bizdate: str, days: int = 30) -> DataFrame:
    """Entities with their last day and a flag for no activity in the last ``days`` days.

    The day is compared as a number, which keeps the aggregation hash-based.
    """
    last = F.max(F.col(day).cast("int")).cast("string")
    gap = F.datediff(day_to_date(F.lit(bizdate)), day_to_date("last_day"))
    return df.groupBy(entity).agg(last.alias("last_day")).withColumn("churned", gap >= days)


def slow_moving(turnover_days: Column | str, limit: float = 60) -> Column:
    c = F.col(turnover_days) if isinstance(turnover_days, str) else turnover_days
    return F.when(c > limit, 1).otherwise(0)


def turnover_days(stock: DataFrame, moves: DataFrame, keys: Sequence[str], qty: str, stock_qty: str) -> DataFrame:
    """Mean stock / mean absolute outbound, each side aggregated before the join so that
    sums do not fan out. ``moves`` has ``movement_type``, compared without case."""
    s = stock.groupBy(*keys).agg(F.sum(stock_qty).alias("_s"), F.count(stock_qty).alias("_sn"))
    out = moves.where(F.lower("movement_type") == "outbound")
    m = out.groupBy(*keys).agg(F.sum(F.abs(qty)).alias("_m"), F.count(qty).alias("_mn"))
    mean_stock = F.try_divide(F.col("_s").cast("double"), F.col("_sn"))
    mean_out = F.try_divide(F.col("_m").cast("double"), F.col("_mn"))
    return s.join(m, list(keys), "left").select(*keys, F.try_divide(mean_stock, mean_out).alias("turnover_days"))


# --- axioms -----------------------------------------------------------------------


def one_parent(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child keys whose number of parents is not one: (key, child_rows, parents).

    Both sides are counted per key first.
    """
    c = child.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("child_rows"))
    p = parent.groupBy(F.col(parent_key).alias("key")).agg(F.count(F.lit(1)).alias("parents"))
    return c.join(p, "key", "left").withColumn("parents", F.coalesce("parents", F.lit(0))).where("parents <> 1")


def conservation(
    parent: DataFrame, child: DataFrame, key: str, child_key: str, total: str, part: str, tol: str = "0.01"
) -> DataFrame:
    """Parents whose total differs from the sum of their parts: (key, total, parts).

    A parent without parts sums to 0."""
    sums = child.groupBy(F.col(child_key).alias("key")).agg(F.sum(part).alias("parts"))
    rows = parent.select(F.col(key).alias("key"), F.col(total).alias("total"))
    joined = rows.join(sums, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))
    return joined.where(F.abs(F.col("total") - F.col("parts")) > F.lit(tol).cast("decimal(18,2)"))


def not_in_window(daily: DataFrame, activity: DataFrame, day: str, entity: str, n: int = 30) -> DataFrame:
    """(entity, day) of ``daily`` without activity in the n days ending that day.

    The last activity is carried forward along each entity's distinct days, so the window
    is never expanded.
    """

    def tagged(df: DataFrame, act: int) -> DataFrame:
        return df.select(entity, F.unix_date(day_to_date(day)).alias("_d"), F.lit(act).alias("_a")).distinct()

    w = Window.partitionBy(entity).orderBy("_d", F.desc("_a")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("_a") == 1, F.col("_d"))).over(w)
    return (
        tagged(activity, 1)
        .unionByName(tagged(daily, 0))
        .withColumn("_last", last)
        .where((F.col("_a") == 0) & (F.col("_last").isNull() | (F.col("_d") - F.col("_last") >= n)))
        .select(entity, F.date_format(F.date_from_unix_date("_d"), "yyyyMMdd").alias(day))
    )
