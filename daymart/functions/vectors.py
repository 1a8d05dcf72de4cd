"""Vector expressions over array columns, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import as_col


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either vector is zero, an error on unequal lengths."""
    x, y = as_col(a), as_col(b)
    norms = l2_norm(x) * l2_norm(y)
    value = F.when(norms == 0, F.lit(0.0)).otherwise(F.try_divide(dot(x, y), norms))
    return F.when(F.size(x) == F.size(y), value).otherwise(
        F.raise_error(F.lit("vectors differ in length")).cast("double")
    )


def _let(value: Column, body) -> Column:
    """Evaluate a value once and use it in a lambda body, which runs per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalise(a: Column | str) -> Column:
    """Unit vector; a zero vector stays as it is."""
    with_norm = _let(as_col(a), lambda v: F.struct(v.alias("v"), l2_norm(v).alias("n")))
    scaled = lambda s: F.transform(s["v"], lambda x: x.cast("double") / F.when(s["n"] == 0, 1.0).otherwise(s["n"]))
    return _let(with_norm, scaled)


def hash_vector(text: Column | str, dim: int = 384) -> Column:
    """Deterministic unit vector: 32 values per SHA-256 of ``text:i``, i = 0, 32, 64 ..."""
    blocks = F.sequence(F.lit(0), F.lit((dim - 1) // 32 * 32), F.lit(32))
    # as Latin-1 text every byte is a character, so all blocks are split in one pass
    digest = lambda i: F.decode(F.unhex(F.sha2(F.concat(as_col(text), F.lit(":"), i.cast("string")), 256)), "ISO-8859-1")
    signs = F.split(F.array_join(F.transform(blocks, digest), ""), "")
    return l2_normalise(F.transform(F.slice(signs, 1, dim), lambda c: (F.ascii(c).cast("double") - 128.0) / 128.0))
