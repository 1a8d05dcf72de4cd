"""Column expressions: guards, casts, enums, classes, flags and derived measures."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Exact money: sums do not depend on row order."""
    return as_col(c).cast("decimal(18,2)")


def project(df: DataFrame, cols: Iterable[Column | str]) -> DataFrame:
    """Explicit projection; star items are refused."""
    cols = list(cols)
    for c in cols:
        if isinstance(c, str) and c.strip().endswith("*"):
            raise ValueError(f"list the columns instead of {c!r}")
    return df.select(*cols)


def safe_div(
    num: Column | str, den: Column | str, scale: int | None = None, positive: bool = False
) -> Column:
    """num / den as double, NULL when the denominator is 0 or NULL.

    ``positive`` also gives NULL for negative denominators (the "> 0" guard form).
    """
    n, d = as_col(num).cast("double"), as_col(den).cast("double")
    out = F.try_divide(n, d)
    if positive:
        out = F.when(d > 0, out)
    return out if scale is None else F.round(out, scale)


def fill_defaults(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """NULL numbers become 0 and NULL strings become ''."""
    wanted = set(cols) if cols is not None else set(df.columns)
    out = {}
    for f in df.schema.fields:
        if f.name not in wanted:
            continue
        if isinstance(f.dataType, T.NumericType):
            out[f.name] = F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            out[f.name] = F.coalesce(F.col(f.name), F.lit(""))
    return df.withColumns(out) if out else df


def conform(df: DataFrame, schema: T.StructType, dirty: bool = False) -> DataFrame:
    """Cast to a target schema in its column order; ``dirty`` turns bad values into NULL.

    Text that cannot be a whole number is set to NULL before the cast: a failing cast
    costs an exception per value.
    """

    def cast(f: T.StructField) -> Column:
        c = F.col(f.name)
        if not dirty:
            return c.cast(f.dataType)
        if isinstance(f.dataType, T.IntegralType) and isinstance(df.schema[f.name].dataType, T.StringType):
            c = F.when(c.rlike(r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*$"), c)
        return c.try_cast(f.dataType)

    return df.select(*[cast(f).alias(f.name) for f in schema.fields])


def decode_enum(col: Column | str, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Code to label through a literal map; unknown codes give ``default``."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    label = F.try_element_at(F.create_map(*pairs), as_col(col))
    return label if default is None else F.coalesce(label, F.lit(default))


def classify(rules: Mapping[str, str | Column], default: str | None = None) -> Column:
    """Name of the first rule that holds."""
    out = None
    for name, rule in rules.items():
        cond = F.expr(rule) if isinstance(rule, str) else rule
        out = F.when(cond, name) if out is None else out.when(cond, name)
    if out is None:
        return F.lit(default).cast("string")
    return out.otherwise(F.lit(default)) if default is not None else out


def scenario_flags(df: DataFrame, conditions: Mapping[str, str | Column]) -> DataFrame:
    """Add self-contained ``is_<name>`` 0/1 flags; every input column stays visible."""
    return df.withColumns(
        {
            f"is_{name}": F.when(F.expr(c) if isinstance(c, str) else c, 1).otherwise(0)
            for name, c in conditions.items()
        }
    )


def any_scenario(names: Iterable[str]) -> Column:
    """OR over scenario flags, the single final filter of a wide table."""
    out = F.lit(False)
    for n in names:
        out = out | (F.col(f"is_{n}") == 1)
    return out


def with_join_key(df: DataFrame, name: str, expr: str | Column) -> DataFrame:
    """Compute a row-conditional join key first, so the join stays an equi-join."""
    return df.withColumn(name, F.expr(expr) if isinstance(expr, str) else expr)


def clamp(df: DataFrame, col: str, lo: float, hi: float, flag: str | None = None) -> DataFrame:
    """Bound a measure to [lo, hi] and mark the rows that were out of range."""
    c = F.col(col)
    bounded = F.when(c < lo, F.lit(lo)).when(c > hi, F.lit(hi)).otherwise(c)
    return df.withColumns(
        {
            flag or f"{col}_clamped": F.when((c < lo) | (c > hi), 1).otherwise(0),
            col: bounded.cast(df.schema[col].dataType),
        }
    )


def ieq(a: Column | str, b: Column | str) -> Column:
    """String equality that ignores case."""
    return F.lower(as_col(a)) == F.lower(as_col(b))


def derive(df: DataFrame, measures: Mapping[str, str | Column]) -> DataFrame:
    """Add measures in order; later ones may use earlier ones."""
    for name, e in measures.items():
        df = df.withColumn(name, F.expr(e) if isinstance(e, str) else e)
    return df


# Declared type names and the folded type each belongs to.
FOLDED_TYPES = {
    "string": "string",
    "varchar": "string",
    "char": "string",
    "text": "string",
    "int": "bigint",
    "integer": "bigint",
    "bigint": "bigint",
    "smallint": "bigint",
    "tinyint": "bigint",
    "double": "decimal",
    "float": "decimal",
    "numeric": "decimal",
    "decimal": "decimal",
    "timestamp": "timestamp",
    "datetime": "timestamp",
    "date": "date",
    "boolean": "boolean",
}


def fold_type(name: str) -> str:
    """Fold a declared type; decimal keeps no precision, unknown types pass lower-cased."""
    low = name.strip().lower()
    if low.startswith("decimal"):
        return "decimal"
    return FOLDED_TYPES.get(low, low)
