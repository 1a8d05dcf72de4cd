"""What the file index knows of a frame's partitions: newest days, and what each scan selects. No data file is read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@dataclass(frozen=True)
class Scan:
    """One file scan of a physical plan; ``node`` is Spark's own."""

    node: Any

    @property
    def partition_columns(self) -> tuple[str, ...]:
        return tuple(self.node.relation().partitionSchema().fieldNames())

    @property
    def partition_filters(self) -> int:
        return self.node.partitionFilters().size()

    @property
    def table(self) -> str | None:
        known = self.node.tableIdentifier()
        return known.get().unquotedString() if known.isDefined() else None

    @property
    def selected(self) -> tuple[int, int, int]:
        """(partitions, files, bytes) after static pruning."""
        chosen = self.node.selectedPartitions()
        return chosen.partitionCount(), chosen.totalNumberOfFiles(), chosen.totalFileSize()

    def values(self, name: str) -> Iterator[tuple[Any, int]]:
        """Value of one partition column and number of files, per selected partition."""
        schema = self.node.relation().partitionSchema()
        at = schema.fieldIndex(name)
        kind = schema.apply(at).dataType()
        parts = self.node.selectedPartitions().filePartitionIterator()
        while parts.hasNext():
            part = parts.next()
            yield _value(part.values().get(at, kind), kind.typeName()), part.numFiles()


def _value(raw: Any, kind: str) -> Any:
    if raw is None:
        return None
    if kind == "date":
        return date(1970, 1, 1) + timedelta(days=raw)
    return raw if isinstance(raw, (bool, int, float)) else raw.toString()


def scans(df: DataFrame) -> list[Scan]:
    """The file scans in a frame's plan, left to right."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    found = (leaves.apply(i) for i in range(leaves.size()))
    return [Scan(leaf) for leaf in found if leaf.getClass().getSimpleName() == "FileSourceScanExec"]


def scan_report(df: DataFrame) -> DataFrame:
    """(scan, table_name, partition_columns, partition_filters, partitions, files, bytes) of every file scan.

    The figures come from the plan and the file index; pruning that only run time can do is not in them.
    """
    rows = [(i, s.table, list(s.partition_columns), s.partition_filters, *s.selected) for i, s in enumerate(scans(df), 1)]
    return df.sparkSession.createDataFrame(
        rows,
        "scan int, table_name string, partition_columns array<string>, partition_filters int,"
        " partitions bigint, files bigint, bytes bigint",
    )


def _day_scan(df: DataFrame, day: str) -> Scan | None:
    """The scan whose partition column ``day`` is, if the frame is that scan and no row filter stands between."""
    node = df.select(F.col(day))._jdf.queryExecution().sparkPlan()
    while node.getClass().getSimpleName() == "ProjectExec":
        item = node.projectList().apply(0)
        if item.getClass().getSimpleName() != "AttributeReference":
            return None
        node = node.child()
    if node.getClass().getSimpleName() != "FileSourceScanExec" or node.dataFilters().size():
        return None
    scan = Scan(node)
    output = node.output().apply(0).name() if node.output().size() else None
    return scan if day in scan.partition_columns and output == day else None


def days(df: DataFrame, day: str = "inc_day") -> list | None:
    """Days of the partitions that hold files, newest first; None where the file index can't tell: the frame is not
    partitioned by the day, or filters rows by other columns."""
    scan = _day_scan(df, day)
    if scan is None:
        return None
    return sorted({v for v, files in scan.values(day) if files and v is not None}, reverse=True)


def newest_with(df: DataFrame, found: Sequence, cond: Column | str, day: str = "inc_day"):
    """The newest of the given days (newest first) with a row that meets the condition.

    Looks at one day, then at twice as many each time, so a recent day is found by reading little and an old one in
    few jobs. Only one value reaches the driver each time.
    """
    at, width = 0, 1
    while at < len(found):
        some = list(found[at : at + width])
        hit = df.where(F.col(day).between(some[-1], some[0])).where(cond).agg(newest_day(df, day)).first()[0]
        if hit is not None:
            return hit
        at, width = at + width, 2 * width
    return None


def newest_day(df: DataFrame, day: str = "inc_day") -> Column:
    """Aggregate: the newest day. Day strings (yyyyMMdd) are compared as numbers, which hash aggregation can keep while
    strings need a sort; what is no such string is left out."""
    if isinstance(df.schema[day].dataType, StringType):
        return F.max(F.col(day).try_cast("int")).cast("string")
    return F.max(day)
