"""Day-partition predicates, date macros and week helpers.

Bounds are computed on the driver and emitted as literals, so they reach the scan as
partition or pushed filters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import as_col


def parse_day(day: str) -> date:
    return datetime.strptime(day, "%Y%m%d").date()


def shift_day(day: str, n: int) -> str:
    return (parse_day(day) + timedelta(days=n)).strftime("%Y%m%d")


def monday_of(day: str) -> str:
    d = parse_day(day)
    return (d - timedelta(days=d.weekday())).strftime("%Y%m%d")


def day_eq(col: Column | str, day: str) -> Column:
    return as_col(col) == day


def day_in(col: Column | str, days: Iterable[str]) -> Column:
    return as_col(col).isin(list(days))


def day_between(col: Column | str, lo: str, hi: str) -> Column:
    return as_col(col).between(lo, hi)


def bounded_until(col: Column | str, hi: str, lo: str | None = None) -> Column:
    """Upper bound that must come with a lower one, or every partition is scanned."""
    if lo is None:
        raise ValueError("an upper day bound needs a lower bound or equality")
    return day_between(col, lo, hi)


def year_window(col: Column | str, bizdate: str) -> Column:
    """From the first day of the run date's year up to the run date."""
    return day_between(col, bizdate[:4] + "0101", bizdate)


def ts_between_days(ts: Column | str, lo: str, hi: str) -> Column:
    """Day range on a raw timestamp column, in the half-open form Parquet can prune on."""
    start = F.lit(parse_day(lo)).cast("timestamp_ntz")
    stop = F.lit(parse_day(hi) + timedelta(days=1)).cast("timestamp_ntz")
    return (as_col(ts) >= start) & (as_col(ts) < stop)


def day_of(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "yyyyMMdd")


def day_to_date(day: Column | str) -> Column:
    return F.to_date(as_col(day), "yyyyMMdd")


def previous_day(day: Column | str, n: int = 1) -> Column:
    """The day string n days earlier, for columns of day strings."""
    return F.date_format(F.date_sub(day_to_date(day), n), "yyyyMMdd")


def iso_week(d: Column | str) -> Column:
    """ISO week label such as 2024-W01 (week-based year)."""
    c = as_col(d)
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), c).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(c).cast("string"), 2, "0"),
    )


def week_start(d: Column | str) -> Column:
    return F.trunc(as_col(d).cast("date"), "week")


# Macro spellings of the scheduler text.
#   ${bizdate}                   the run date
#   $[time(yyyyMMdd,-Nd)]        N days before the scheduling day (run date + 1)
#   $[monday(yyyyMMdd,-Nd)]      Monday of the week holding that day
_MACRO = re.compile(r"\$\[(time|monday)\(yyyyMMdd,([+-]?\d+)d\)\]|\$\{bizdate\}")


def resolve_macro(text: str, bizdate: str) -> str:
    """Replace date macros by literals. The run date is T-1, so ``-1d`` is the run date."""

    def value(m: re.Match) -> str:
        if m.group(1) is None:
            return bizdate
        day = shift_day(bizdate, int(m.group(2)) + 1)
        return monday_of(day) if m.group(1) == "monday" else day

    return _MACRO.sub(value, text)
