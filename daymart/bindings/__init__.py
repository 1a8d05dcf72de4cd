"""Queries over the shared test tables, each with an equivalent statement in plain SQL.

A binding declares its output columns once; the same casts are applied to the Spark result
and to the SQL text, so both sides have equal names and types.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODULES = ("expressions", "joins", "aggregates", "windows", "profiles", "checks", "metrics", "marts", "text", "corpus", "tables")

# column kinds: Spark type, SQL type
KINDS = {"s": ("string", "VARCHAR"), "i": ("bigint", "BIGINT"), "d": ("double", "DOUBLE"), "b": ("boolean", "BOOLEAN")}


@dataclass(frozen=True)
class Binding:
    fn: Callable[[SparkSession, str], DataFrame]
    cols: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.fn(spark, folder)
        out = []
        for name, kind in self.cols:
            c = F.col(name)
            if kind.startswith("r"):
                c = F.round(c.cast("double"), int(kind[1:]))
            else:
                c = c.cast(KINDS[kind][0])
            out.append(c.alias(name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        items = [
            f'round(CAST("{n}" AS DOUBLE), {k[1:]}) AS "{n}"' if k.startswith("r") else f'CAST("{n}" AS {KINDS[k][1]}) AS "{n}"'
            for n, k in self.cols
        ]
        return f"SELECT {', '.join(items)} FROM ({self.sql.strip()}) AS result"


REGISTRY: dict[str, Binding] = {}


def bind(name: str, cols: str, sql: str | None = None):
    """Register a query. ``cols`` lists ``column:kind`` with kind s, i, d, b or r<digits>."""

    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"{name} is bound twice")
        pairs = tuple(tuple(c.rsplit(":", 1)) for c in cols.split())
        REGISTRY[name] = Binding(fn, pairs, sql)
        return fn

    return wrap


def all_bindings() -> dict[str, Binding]:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return REGISTRY
