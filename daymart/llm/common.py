"""Helpers shared by the operators: column hygiene, Arrow chunks, word and byte kernels."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: bytes of text that one numpy step works on; a longer document is a step of its own
CHUNK_BYTES = 1 << 20
#: rows of one step at most
CHUNK_ROWS = 4096
#: rows that Spark sends to Python at once, at most; texts are long, so its default of 10,000 takes much memory
BATCH_ROWS = 2048


def body(text_col: str = "text") -> Column:
    """The text as string, null as empty."""
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def raw(text_col: str = "text") -> Column:
    """The text's UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit(b""))


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def chunk_batches(spark: SparkSession) -> None:
    """Have the session send Python about one chunk of text at once, for jobs whose workers hold much besides. A batch ends
    with the row that reaches the bound, so it is a little less than a chunk."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(CHUNK_BYTES * 15 // 16))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@dataclass
class Chunk:
    """Rows ``lo`` to ``hi`` of a batch; ``data`` holds their bytes, row i from starts[i] to starts[i + 1]."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a binary or string column into steps of about ``limit`` bytes, whole rows each; null counts as empty."""
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + CHUNK_ROWS)
        yield Chunk(lo, hi, flat[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """Finishing steps of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = 0x9E3779B97F4A7C15  # base of the rolling hashes; odd, so it has an inverse modulo 2**64
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2**64, kept for the largest n asked for up to one chunk."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.ones(n + 1, np.uint64)
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        if n <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have[: n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of byte code times base ** position, so a slice's hash is (p[b] - p[a]) * base ** -a."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_ODD, len(data))[:-1], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices [a, b)."""
    return mix64((prefix[b] - prefix[a]) * powers(_INVERSE, len(prefix) - 1)[a] + (b - a).astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every maximal run of bytes with ``inside`` true, and the first word of each row (n + 1 values)."""
    n = len(data)
    flag = np.zeros(n + 2, bool)
    flag[1:-1] = inside
    begin = flag[1:] & ~flag[:-1]
    end = ~flag[1:] & flag[:-1]
    cuts = starts[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    if len(cuts):  # a word never runs over a row's end
        joined = cuts[inside[cuts] & inside[cuts - 1]]
        begin[joined] = True
        end[joined] = True
    a = np.flatnonzero(begin)
    b = np.flatnonzero(end)
    return a, b, np.searchsorted(a, starts)


def space_words(data: np.ndarray, starts: np.ndarray):
    return word_spans(data, starts, ~_SPACE[data])


def alnum_words(data: np.ndarray, starts: np.ndarray):
    return word_spans(data, starts, _ALNUM[data])


_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII bytes, A-Z in lower case."""
    return text.translate(_TO_WORDS).split()


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of begin[i], begin[i] + 1, ... count[i] values each."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return np.arange(total, dtype=np.int64) + shift


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def plain(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text's bytes, under names of their own, so that no other column can clash."""
    small_batches(df.sparkSession)
    return df.select(column(id_col).alias("doc_id"), raw(text_col).alias("body"))


def give_back() -> None:
    """Return unused memory to the system."""
    _powers.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Return what is free already, which takes no time to find."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, giving memory back at its end: Python workers outlive their tasks, and what they keep counts against
    the executor while later stages run."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def annotate(
    docs: DataFrame,
    start: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    fields: str,
    text_col: str = "text",
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Add columns that Python derives from the text's bytes, one Arrow batch after the other, without a shuffle.

    ``start`` runs once per task and returns the function from a batch's texts to the new columns. ``keep`` names the
    columns to carry along (all by default); they travel under numbered names, so no name can clash on the way.
    """
    small_batches(docs.sparkSession)
    keep = tuple(docs.columns) if keep is None else keep
    names = [f"k{i}" for i in range(len(keep))]
    inner = docs.select(*[column(c).alias(n) for c, n in zip(keep, names)], raw(text_col).alias("body"))
    added = StructType.fromDDL(fields)
    schema = StructType([*inner.schema.fields[:-1], *added.fields])
    body_at = len(names)
    if text_col in keep and docs.schema[text_col].dataType == StringType():  # the text needs to travel once only
        body_at = keep.index(text_col)
        inner = inner.drop("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            out = work(batch.column(body_at))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], *out], names=[*names, *added.names])

    return inner.mapInArrow(tidy(run), schema).toDF(*keep, *added.names)
