"""Named functions, metrics and checks that statements and check files can call.

Everything becomes a SQL function of the session, so Catalyst inlines its body: a metric called with a constant is one
filtered aggregation, called with a column it is a join.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import quality

_NAME = re.compile(r"^[A-Za-z_]\w*$")


def _valid(name: str) -> str:
    if not _NAME.match(name):
        raise ValueError(f"{name!r} is no function name")
    return name


@dataclass
class Registry:
    """What users add; ``install`` makes it callable in a session.

    ``args`` are SQL parameter lists such as ``"day STRING, n INT DEFAULT 7"``. Bodies name sources as tables and may
    call what was registered before. In a body, ``name.arg`` is the parameter where a column has the same name.
    """

    statements: dict[str, str] = field(default_factory=dict)
    python: dict[str, Callable] = field(default_factory=dict)

    def _add(self, name: str, text: str) -> None:
        if name in self.statements or name in self.python:
            raise ValueError(f"{name} is registered twice")
        self.statements[_valid(name)] = f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{text}"

    def function(self, name: str, args: str, returns: str, body: str) -> None:
        """A value made of its arguments."""
        self._add(name, f"({args}) RETURNS {returns} RETURN {body}")

    def metric(self, name: str, source: str, expression: str, where: str = "", args: str = "", returns: str = "DOUBLE") -> None:
        """An aggregate over a source's rows; without such rows what SQL gives for none (NULL, or 0 for a count)."""
        rows = f"{source} WHERE {where}" if where else source
        self._add(name, f"({args}) RETURNS {returns} RETURN (SELECT {expression} FROM {rows})")

    def check(self, name: str, args: str, rows: str) -> None:
        """A query of the rows that break a rule, called as a table."""
        self._add(name, f"({args}) RETURNS TABLE RETURN {rows}")

    def udf(self, name: str, fn: Callable) -> None:
        """A Python function of the ``udf`` or ``pandas_udf`` kind, for what SQL can't say."""
        if name in self.statements or name in self.python:
            raise ValueError(f"{name} is registered twice")
        self.python[_valid(name)] = fn

    def install(self, spark: SparkSession, sources: Mapping[str, DataFrame]) -> None:
        """Make sources and functions known to the session, in the order of registration."""
        for name, df in sources.items():
            df.createOrReplaceTempView(_valid(name))
        for name, fn in self.python.items():
            spark.udf.register(name, fn)
        for statement in self.statements.values():
            spark.sql(statement)

    def run_checks(self, spark: SparkSession, sources: Mapping[str, DataFrame], text: str, bizdate: str | None = None) -> DataFrame:
        """Run a check file whose statements may call what is registered, and name sources as ``name`` or ``{name}``."""
        self.install(spark, sources)
        return quality.run_sql_checks(spark, sources, text, bizdate)
