"""Data-quality checks that are evaluated on the data.

A check is a measured number and an abnormal-if predicate on it. Checks over the same rows of
a table share a single aggregation; cross-table checks bring their own small frame.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.days import previous_day, resolve_macro
from .windows import period_change

# Deduction per weight name; other names count as Medium.
WEIGHTS = {"High": 30, "Medium": 15, "Low": 5}
# Score bands and the weight from which a failure is severe.
GREEN_FROM, YELLOW_FROM, SEVERE_FROM = 90, 70, 30
# Role markers in result-table names.
TARGET_MARKERS = ("ads", "dm", "results")

RESULT_SCHEMA = "category string, name string, weight int, measured double, threshold string, message string"


@dataclass(frozen=True)
class Check:
    """One check. Either ``measure`` (an aggregate over ``source``) or ``frame`` (a
    function of all sources giving one row with a number) is set. ``where`` limits the rows
    of the source, usually to its day partitions, and reaches the scan. A measure counts
    rows unless ``ratio`` says that it is a share already; a percent threshold is compared
    with the share of the source's rows."""

    category: str
    name: str
    source: str = ""
    measure: Column | str | None = None
    frame: Callable[[Mapping[str, DataFrame]], DataFrame] | None = None
    weight: str = "Medium"
    threshold: str = ">0"
    where: str = ""
    ratio: bool = False

    @property
    def points(self) -> int:
        return WEIGHTS.get(self.weight, 15)


# --- measures over one table ------------------------------------------------------


def nulls(cols: Sequence[str]) -> Column:
    """Rows with a NULL in any of the columns."""
    return F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]))


def breaks(cond: str | Column) -> Column:
    """Rows that match a forbidden pattern."""
    return F.count_if(F.expr(cond) if isinstance(cond, str) else cond)


def formula(lhs: str, rhs: str, tol: float = 0.01) -> Column:
    """Rows where two expressions differ by more than the tolerance."""
    return F.count_if(F.abs(F.expr(lhs) - F.expr(rhs)) > F.lit(str(tol)).cast("decimal(18,6)"))


def out_of_range(col: str, lo: float | None = None, hi: float | None = None) -> Column:
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (F.col(col) < lo)
    if hi is not None:
        bad = bad | (F.col(col) > hi)
    return F.count_if(bad)


def blanks(col: str) -> Column:
    """Rows whose value is NULL or blank."""
    return F.count_if(F.col(col).isNull() | (F.trim(F.col(col)) == ""))


def unmatched(col: str, regex: str) -> Column:
    """Non-NULL values that do not match the format."""
    return F.count_if(~F.col(col).rlike(regex))


def stale_days(day: str, bizdate: str) -> Column:
    """Days between the newest partition and the expected one; NULL on an empty table."""
    return F.datediff(F.to_date(F.lit(bizdate), "yyyyMMdd"), F.to_date(F.max(day), "yyyyMMdd"))


def day_volume_change(day: str, bizdate: str) -> Column:
    """|change| of the run day's row count against the day before, as a share."""
    now = F.count_if(F.col(day) == bizdate).cast("double")
    before = F.count_if(F.col(day) == previous_day(F.lit(bizdate))).cast("double")
    return F.abs(F.try_divide(now - before, before))


# --- frames -----------------------------------------------------------------------


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


def unique(source: str, keys: Sequence[str]) -> Callable:
    return lambda t: duplicate_keys(t[source], keys).agg(F.count(F.lit(1)).alias("measured"))


def count_gap(target: str, source: str) -> Callable:
    """Relative difference of two row counts; both tables are reduced to one number first."""

    def frame(t: Mapping[str, DataFrame]) -> DataFrame:
        a = t[target].select(F.lit(1).alias("t"), F.lit(0).alias("s"))
        b = t[source].select(F.lit(0).alias("t"), F.lit(1).alias("s"))
        gap = F.abs(F.sum("t") - F.sum("s")).cast("double")
        return a.unionByName(b).agg(F.try_divide(gap, F.sum("s").cast("double")).alias("measured"))

    return frame


def misaligned(source: str, keys: Sequence[str], dim: str, dim_keys: Sequence[str] | None = None) -> Callable:
    """Distinct key values that the dimension lacks."""

    def frame(t: Mapping[str, DataFrame]) -> DataFrame:
        known = t[dim].select(*[F.col(k).alias(n) for k, n in zip(dim_keys or keys, keys)]).distinct()
        return t[source].select(*keys).distinct().join(known, list(keys), "left_anti").agg(
            F.count(F.lit(1)).alias("measured")
        )

    return frame


def daily_volume(df: DataFrame, day: str) -> DataFrame:
    """Row count per day with the change against the day before it in the table."""
    return period_change(df.groupBy(day).agg(F.count(F.lit(1)).alias("cnt")), day, "cnt")


def volume_band(df: DataFrame, day: str, last: str, days: int = 7, band: float = 0.3) -> DataFrame:
    """Days of the window up to ``last`` whose change leaves the band."""
    lo = F.date_format(F.date_sub(F.to_date(F.lit(last), "yyyyMMdd"), days), "yyyyMMdd")
    series = daily_volume(df.where(F.col(day).between(lo, F.lit(last))), day)
    return series.where(F.abs("pct_change") > band * 100)


def share_anomaly(df: DataFrame, col: str, bound: float) -> DataFrame:
    """Values that hold more than ``bound`` of all rows."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.col("cnt").cast("double") / total).where(F.col("share") > bound)


# --- suites -----------------------------------------------------------------------


def _result_row(check: Check, measured: Column, message: Column | None = None) -> list[Column]:
    return [
        F.lit(check.category).alias("category"),
        F.lit(check.name).alias("name"),
        F.lit(check.points).alias("weight"),
        measured.cast("double").alias("measured"),
        F.lit(check.threshold).alias("threshold"),
        (message if message is not None else F.lit(None)).cast("string").alias("message"),
    ]


def _error_frame(spark: SparkSession, check: Check, error: Exception) -> DataFrame:
    text = getattr(error, "getCondition", lambda: None)() or type(error).__name__
    row = (check.category, check.name, check.points, None, check.threshold, text)
    return spark.createDataFrame([row], RESULT_SCHEMA)


def _shared_pass(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """All measures of one table in one aggregation, turned to one row per check."""
    wide = df.agg(*[_measure(c).cast("double").alias(f"m{i}") for i, c in enumerate(checks)])
    rows = F.array(*[F.struct(*_result_row(c, F.col(f"m{i}"))) for i, c in enumerate(checks)])
    return wide.select(F.inline(rows))


def _rows(check: Check, sources: Mapping[str, DataFrame]) -> DataFrame:
    df = sources[check.source]
    return df.where(check.where) if check.where else df


def _measure(check: Check) -> Column:
    value = F.expr(check.measure) if isinstance(check.measure, str) else check.measure
    if check.threshold.rstrip().endswith("%") and not check.ratio:
        return F.try_divide(value.cast("double"), F.count(F.lit(1)))
    return value


def _single(check: Check, sources: Mapping[str, DataFrame]) -> DataFrame:
    if check.frame is not None:
        out = check.frame(sources)
        return out.select(*_result_row(check, F.col(out.columns[0])))
    return _shared_pass(_rows(check, sources), [check])


def measure_suite(sources: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """Lazy frame of measured checks; a check that fails analysis becomes an error row."""
    spark = next(iter(sources.values())).sparkSession
    parts: list[DataFrame] = []
    shared: dict[tuple[str, str], list[Check]] = {}  # by source and row filter
    for c in checks:
        try:  # analysis only, no job
            if c.frame is not None:
                alone = _single(c, sources)
                alone.schema
                parts.append(alone)
            else:
                _rows(c, sources).agg(_measure(c)).schema
                shared.setdefault((c.source, c.where), []).append(c)
        except (PySparkException, KeyError) as e:
            parts.append(_error_frame(spark, c, e))
    parts += [_shared_pass(_rows(cs[0], sources), cs) for cs in shared.values()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def evaluate(results: DataFrame) -> DataFrame:
    """Apply ``op number[%]`` as abnormal-if on the measured value.

    No measured value means FAILED when the check errored, else SKIPPED; so does a
    threshold that cannot be read.
    """
    shape = r"^\s*(>=|<=|!=|>|<|=)\s*(-?[0-9]+(?:\.[0-9]+)?)\s*(%?)\s*$"
    op = F.regexp_extract("threshold", shape, 1)
    number = F.nullif(F.regexp_extract("threshold", shape, 2), F.lit("")).cast("double")
    bound = F.when(F.regexp_extract("threshold", shape, 3) == "%", number / 100).otherwise(number)
    m = F.col("measured")
    abnormal = (
        F.when(op == ">", m > bound)
        .when(op == ">=", m >= bound)
        .when(op == "<", m < bound)
        .when(op == "<=", m <= bound)
        .when(op == "=", m == bound)
        .when(op == "!=", m != bound)
    )
    status = (
        F.when(F.col("message").isNotNull(), "FAILED")
        .when(abnormal.isNull(), "SKIPPED")
        .when(abnormal, "FAILED")
        .otherwise("PASSED")
    )
    return results.withColumn("status", status)


def suite(sources: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    return evaluate(measure_suite(sources, checks))


def run_suite(sources: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """Run now. If the shared run fails, checks run one by one and the broken ones become
    error rows. Only one row per check comes to the driver."""
    spark = next(iter(sources.values())).sparkSession
    try:
        rows = [tuple(r) for r in measure_suite(sources, checks).collect()]
    except PySparkException:
        rows = []
        for c in checks:
            try:
                rows += [tuple(r) for r in _single(c, sources).collect()]
            except (PySparkException, KeyError) as e:
                rows += [tuple(r) for r in _error_frame(spark, c, e).collect()]
    return evaluate(spark.createDataFrame(rows, RESULT_SCHEMA))


# --- roll-ups ---------------------------------------------------------------------


def score(results: DataFrame) -> DataFrame:
    """Health score: 100 minus the weights of failed checks, floor 0, with its band."""
    lost = F.coalesce(F.sum(F.when(F.col("status") == "FAILED", F.col("weight"))), F.lit(0))
    out = results.agg(F.greatest(F.lit(0), 100 - lost).cast("bigint").alias("score"))
    band = F.when(F.col("score") >= GREEN_FROM, "green").when(F.col("score") >= YELLOW_FROM, "yellow")
    return out.withColumn("band", band.otherwise("red"))


def summary(results: DataFrame) -> DataFrame:
    """Counts, pass rate as whole percent (0 when empty) and severe failures."""
    failed = F.col("status") == "FAILED"
    passed = F.count_if(F.col("status") == "PASSED")
    total = F.count(F.lit(1))
    return results.agg(
        total.alias("total"),
        passed.alias("passed"),
        F.count_if(failed).alias("failed"),
        F.when(total == 0, F.lit(0)).otherwise(F.floor(F.try_divide(passed * 100, total))).cast("bigint").alias("pass_rate"),
        F.count_if(failed & (F.col("weight") >= SEVERE_FROM)).alias("severe"),
    )


# Category keywords (English, Chinese) and the advice given for each.
HINTS = (
    (("uniqueness", "primary key", "唯一性", "主键"), "look for duplicate upstream rows or a join that multiplies rows"),
    (("refutation", "反证"), "look for unexpected rows let in by join or filter conditions"),
    (("timeliness", "时效性"), "look for a late job or a stalled source sync"),
    (("consistency", "一致性"), "look for padding differences or missing dimension rows"),
)
DEFAULT_HINT = "review the business rule by hand"


def hints(results: DataFrame) -> DataFrame:
    """Advice for failed checks by keyword in category and name; '-' otherwise."""
    label = F.lower(F.concat_ws("-", "category", "name"))
    advice = F.when(F.col("status") != "FAILED", "-")
    for words, text in HINTS:
        advice = advice.when(reduce(lambda a, b: a | b, [label.contains(w) for w in words]), text)
    return results.withColumn("hint", advice.otherwise(DEFAULT_HINT))


def table_roles(tables: DataFrame, name: str = "table_name") -> DataFrame:
    """Result table or upstream table, by marker in the name."""
    return tables.withColumn(
        "role", F.when(F.lower(name).rlike("|".join(TARGET_MARKERS)), "target").otherwise("upstream")
    )


# --- checks supplied as SQL text ----------------------------------------------------


@dataclass(frozen=True)
class SqlCase:
    category: str
    name: str
    sql: str
    weight: str = "Medium"
    threshold: str = ">0"
    expect: str = ""


# The header line and the comment labels of a check file.
_HEADER = re.compile(r"^--\s*\[([^\]]*?)-([^\]]*)\]", re.M)
_LABEL = re.compile(r"^--\s*(权重|weight|阈值|threshold|预期|expect)\s*[:：]\s*(.+?)\s*$", re.M | re.I)
_EXPECTED_VALUE = re.compile(r"^\s*(\w+)\s*=\s*('?)([^'\s]*)\2\s*$")
_EXPECTED_BAND = re.compile(r"^\s*(\w+)\s*(?:在|within)\s*[±+-]*\s*(\d+(?:\.\d+)?)\s*%")


def read_cases(text: str) -> list[SqlCase]:
    """Cases of a check file: a ``-- [category-name]`` header, labels, one statement each."""
    starts = list(_HEADER.finditer(text))
    out = []
    for i, m in enumerate(starts):
        stop = starts[i + 1].start() if i + 1 < len(starts) else len(text)
        block = text[m.end() : stop]
        case = SqlCase(m.group(1).strip(), m.group(2).strip(), "")
        for label, value in _LABEL.findall(block):
            slot = {"权重": "weight", "阈值": "threshold", "预期": "expect"}.get(label, label.lower())
            case = replace(case, **{slot: value})
        lines = [ln for ln in block.split("\n")[1:] if not ln.strip().startswith("--")]
        out.append(replace(case, sql="\n".join(lines).strip().rstrip(";").strip()))
    return out


def _offending(rows: DataFrame, expect: str) -> Column:
    """How many rows break an expectation: any row, a value that differs (no row at all breaks it too), or a percent
    change outside a band, where a missing one does not count."""
    if value := _EXPECTED_VALUE.match(expect):
        wrong = F.count_if(~F.col(value[1]).cast("string").eqNullSafe(F.lit(value[3])))
        return F.when(F.count(F.lit(1)) == 0, 1).otherwise(wrong)
    if band := _EXPECTED_BAND.match(expect):
        return F.count_if(F.abs(F.col(band[1]).cast("double")) > float(band[2]))
    # whole rows are evaluated, so that a failing expression of the select list is seen
    return F.count_if(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))) >= 0)


def sql_check(spark: SparkSession, case: SqlCase, bizdate: str | None = None) -> Check:
    """A statement and what is expected of its rows; the measured value is the number of rows that break it.

    Date macros are resolved for ``bizdate`` in the statement and the expectation; a case with a macro left over, or
    with one and no run date, is an error and never passes.
    """

    def frame(t: Mapping[str, DataFrame]) -> DataFrame:
        sql, expect = case.sql, case.expect
        if bizdate is not None:
            sql, expect = resolve_macro(sql, bizdate), resolve_macro(expect, bizdate)
        if left := re.search(r"\$[\[{][^\]}]*[\]}]?", sql + expect):
            raise KeyError(f"unresolved {left[0]}")
        rows = spark.sql(sql, **t)
        return rows.agg(_offending(rows, expect).alias("measured"))

    return Check(case.category, case.name, frame=frame, weight=case.weight, threshold=case.threshold)


def run_sql_checks(spark: SparkSession, sources: Mapping[str, DataFrame], text: str, bizdate: str | None = None) -> DataFrame:
    """Run a check file whose statements name sources as ``{name}``, for one run date."""
    return suite(sources, [sql_check(spark, c, bizdate) for c in read_cases(text)])
