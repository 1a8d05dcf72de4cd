"""Run-log fingerprints and scorecards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import missing_terms


@dataclass(frozen=True)
class LogMarks:
    """The texts that mark each kind of log line."""

    timeout: str = "LLM CLI 调用超时"
    retry: str = "重试"
    retry_logger: str = ".llm"
    platform: tuple[str, ...] = ("302 Found", "连接失败")
    degraded: str = "降级"


def log_marks(df: DataFrame, marks: LogMarks = LogMarks(), line: str = "value") -> DataFrame:
    """0/1 flags per line. A timeout line is never also a retry; the others are additive."""
    has = lambda s: F.contains(F.col(line), F.lit(s))
    platform = F.lit(False)
    for p in marks.platform:
        platform = platform | has(p)
    return df.withColumns(
        {
            "timeout": has(marks.timeout).cast("int"),
            "retry": (~has(marks.timeout) & has(marks.retry) & has(marks.retry_logger)).cast("int"),
            "platform_error": platform.cast("int"),
            "degraded": has(marks.degraded).cast("int"),
        }
    )


LOG_COUNTS = {"timeout": "timeouts", "retry": "retries", "platform_error": "platform_errors", "degraded": "degradations"}


def log_health(df: DataFrame, keys: Sequence[str] = (), marks: LogMarks = LogMarks(), line: str = "value") -> DataFrame:
    """Line counts per kind, for the whole log or per key."""
    return log_marks(df, marks, line).groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for c, n in LOG_COUNTS.items()]
    )


# Finding severities that get a column each.
SEVERITIES = ("Critical", "Warning")


def scorecard(checks: DataFrame, findings: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case: passed (no failed check; a skip is no failure) and findings by severity.

    Both sides are one row per case before the join.
    """
    per_case = checks.groupBy(case).agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(F.col("status") == "skip").alias("skipped"),
    )
    found = findings.groupBy(case).pivot("severity", list(SEVERITIES)).agg(F.count(F.lit(1)))
    found = found.withColumnsRenamed({s: s.lower() for s in SEVERITIES})
    cols = [s.lower() for s in SEVERITIES]
    joined = per_case.join(found, case, "left").na.fill(0, cols)
    return joined.withColumn("passed", F.col("failed") == 0)


def findings_by_dimension(findings: DataFrame, default: str = "general") -> DataFrame:
    """Findings by dimension x severity; findings without a dimension go to ``default``."""
    dim = F.coalesce(F.col("dimension"), F.lit(default)).alias("dimension")
    out = findings.where(F.col("severity").isin(*SEVERITIES)).groupBy(dim).pivot("severity", list(SEVERITIES)).agg(F.count(F.lit(1)))
    return out.withColumnsRenamed({s: s.lower() for s in SEVERITIES}).na.fill(0)


def missing_keywords(docs: DataFrame, required: Mapping[str, Sequence[str]], kind: str, key: str, text: str = "text") -> DataFrame:
    """Required terms a document of its kind lacks; kinds without a rule and blank
    documents pass."""
    out = F.array().cast("array<string>")
    for name, terms in required.items():
        out = F.when(F.col(kind) == name, missing_terms(text, terms)).otherwise(out)
    out = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", F.array().cast("array<string>")).otherwise(out)
    return docs.select(key, kind, out.alias("missing")).where(F.size("missing") > 0)
