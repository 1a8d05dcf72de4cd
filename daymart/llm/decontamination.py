"""Benchmark decontamination: an FM-index per training shard, searched for the benchmark's word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import StageArea
from .common import Chunk, alnum_words, annotate, chunks, column, lower, ranges, raw, split_words
from .fmindex import FMIndex

#: benchmark words that one search takes; a larger benchmark is searched in several passes
BLOCK_WORDS = 1_000_000
#: bytes of text per FM-index
SHARD_BYTES = 1 << 20

FIELDS = "n_words long, hits array<int>, items array<string>"


@dataclass(frozen=True)
class Block:
    """Part of the benchmark: word ids from 2, distinct windows by length, and the items that hold each."""

    vocabulary: dict[bytes, int]
    windows: tuple[np.ndarray, ...]
    owners: tuple[tuple[np.ndarray, np.ndarray], ...]  # per length: offsets and item numbers
    items: tuple[str, ...]
    shortest: int


def _block(items: list[tuple[str, list[bytes]]], width: int) -> Block:
    vocabulary: dict[bytes, int] = {}
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    held: dict[int, dict[tuple[int, ...], set[int]]] = {}
    for name, words in items:
        ids = tuple(vocabulary.setdefault(w, len(vocabulary) + 2) for w in words)
        size = min(width, len(ids))
        for k in range(len(ids) - size + 1):
            held.setdefault(size, {}).setdefault(ids[k : k + size], set()).add(number[name])
    windows, owners = [], []
    for size in sorted(held):
        windows.append(np.array(list(held[size]), np.int64))
        lists = [sorted(x) for x in held[size].values()]
        owners.append((np.concatenate(([0], np.cumsum([len(x) for x in lists]))), np.array([y for x in lists for y in x], np.int64)))
    return Block(vocabulary, tuple(windows), tuple(owners), tuple(names), min(held))


def blocks(benchmark: DataFrame, width: int, id_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_words`` words; it is streamed and never held whole."""
    rows = benchmark.select(F.coalesce(column(id_col).cast("string"), F.lit("null")), raw(text_col))
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for name, text in rows.toLocalIterator():
        words = split_words(bytes(text))
        if words:
            held.append((name, words))
            size += len(words)
        if size >= block_words:
            yield _block(held, width)
            held, size = [], 0
    if held:
        yield _block(held, width)


def _search(block: Block, part: Chunk) -> tuple[list[np.ndarray], list[list[str]], np.ndarray]:
    """Hit words and items of each document of a shard, and word counts."""
    get = block.vocabulary.get
    n = len(part)
    counts = np.zeros(n, np.int64)
    pieces = []
    for i in range(n):
        words = split_words(part.text(i))
        counts[i] = len(words)
        ids = np.zeros(len(words) + 1, np.int64)  # 0 also ends the document
        ids[:-1] = list(map(get, words, repeat(0)))
        pieces.append(ids)
    text = np.concatenate(pieces)
    base = np.concatenate(([0], np.cumsum(counts + 1)))
    # a window can only stand in a run of benchmark words that is long enough
    known = np.concatenate(([False], text > 0, [False]))
    begin = np.flatnonzero(known[1:] & ~known[:-1])
    size = np.flatnonzero(~known[1:] & known[:-1]) - begin
    begin, size = begin[size >= block.shortest], size[size >= block.shortest]
    nothing: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    if not len(begin):
        return nothing, [[] for _ in range(n)], counts
    place = ranges(begin, size + 1)  # each run with the 0 that follows it
    seq = np.where(text[place] > 0, text[place], 1)
    index = FMIndex(seq, len(block.vocabulary) + 1)
    cover = np.zeros(len(text) + 1, np.int64)
    owned = []
    for windows, (offsets, items) in zip(block.windows, block.owners):
        low, high = index.search(windows)
        some = np.flatnonzero(high > low)
        if not len(some):
            continue
        times = high[some] - low[some]
        at = place[index.locate(ranges(low[some], times))]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + windows.shape[1], -1)
        doc = np.searchsorted(base, at, side="right") - 1
        window = np.repeat(some, times)
        pairs = np.unique(doc * len(offsets) + window)  # each window once per document
        doc, window = pairs // len(offsets), pairs % len(offsets)
        share = offsets[window + 1] - offsets[window]
        owned.append(np.repeat(doc, share) * len(block.items) + items[ranges(offsets[window], share)])
    if not owned:
        return nothing, [[] for _ in range(n)], counts
    hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
    cut = np.searchsorted(hit, base)
    hits = [hit[cut[i] : cut[i + 1]] - base[i] for i in range(n)]
    pairs = np.unique(np.concatenate(owned))
    cut = np.searchsorted(pairs, np.arange(n + 1) * len(block.items))
    items = [[block.items[k] for k in pairs[cut[i] : cut[i + 1]] - i * len(block.items)] for i in range(n)]
    return hits, items, counts


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    keep: tuple[str, ...] | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Every document with ``n_words``, ``hits`` (numbers of the words inside an occurring window, ascending) and
    ``items`` (ids of the items with occurring windows, ascending as strings).

    Words are letters, digits and non-ASCII characters, A-Z in lower case. A window is ``window`` consecutive words
    of an item, or all words of a shorter one. Null text has no words; an item without words has no window; items
    that repeat an id count once; a null item id is called ``null``. Repeated documents are answered one by one, an
    empty table gives an empty result and an empty benchmark hits nothing. Columns in ``keep`` (all by default) are
    carried along.
    """
    keep = tuple(docs.columns) if keep is None else keep
    names = [f"c{i}" for i in range(len(keep))]  # no column of the input can clash with one of ours
    found = docs.select(*[column(c).alias(n) for c, n in zip(keep, names)], column(text_col).cast("string").alias("searched"))
    area = None
    passes = 0
    for block in blocks(benchmark, window, item_id_col, item_text_col, block_words):
        if passes == 1:  # more passes over the same texts: write each, so that the chain stays short
            area = StageArea(docs.sparkSession, "contamination")
        if area is not None:
            found = area.save(found)
        found = annotate(found, _searcher(block), FIELDS, "searched")
        if passes:  # one more block: its words and items join those found before
            found = found.withColumns({"hits_0": F.array_union("hits_0", "hits"), "items_0": F.array_union("items_0", "items")})
            found = found.drop("n_words", "hits", "items")
        else:
            found = found.withColumnsRenamed({"n_words": "n_words_0", "hits": "hits_0", "items": "items_0"})
        passes += 1
    if not passes:
        found = annotate(found, _counter, "n_words_0 long", "searched")
        found = found.withColumns({"hits_0": F.array().cast("array<int>"), "items_0": F.array().cast("array<string>")})
    elif passes > 1:
        found = found.withColumns({"hits_0": F.sort_array("hits_0"), "items_0": F.sort_array("items_0")})
    return found.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)], F.col("n_words_0").alias("n_words"), F.col("hits_0").alias("hits"), F.col("items_0").alias("items")
    )


def _searcher(block: Block):
    def start():
        def work(texts: pa.Array) -> list[pa.Array]:
            words, hits, items = [], [], []
            for part in chunks(texts, SHARD_BYTES):
                h, i, n = _search(block, part)
                words.append(n)
                hits += h
                items += i
            return [
                pa.array(np.concatenate(words) if words else np.zeros(0, np.int64)),
                pa.array(hits, pa.list_(pa.int32())),
                pa.array(items, pa.list_(pa.string())),
            ]

        return work

    return start


def _counter():
    def work(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([len(split_words(part.text(i))) for part in chunks(texts) for i in range(len(part))], pa.int64())]

    return work


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Counts of ``contamination`` per document, with the hit items as one SHA-256."""
    found = contamination(docs, benchmark, keep=(id_col,), **options)
    return found.select(
        column(id_col).alias("doc_id"),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def removal_spans(text: bytes, hits: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of the runs of consecutive hit words, from a run's first byte to its last."""
    data = lower(np.frombuffer(text, np.uint8))
    begin, end, _ = alnum_words(data, np.array([0, len(data)]))
    edge = np.flatnonzero(np.diff(hits) > 1)
    first, last = np.concatenate((hits[:1], hits[edge + 1])), np.concatenate((hits[edge], hits[-1:]))
    return list(zip(begin[first].tolist(), end[last].tolist()))


def _cut(text: str | None, hits: np.ndarray) -> str | None:
    if text is None or not len(hits):
        return text
    whole = text.encode()
    kept, at = [], 0
    for a, b in removal_spans(whole, np.asarray(hits)):
        kept.append(whole[at:a])
        at = b
    return b"".join([*kept, whole[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with the hit word runs cut out of their texts; documents without a hit stay as they are, all rows and
    columns stay. Cutting joins what stood around a run; the text may become empty. A cut text's length in
    characters goes to ``chars_col`` if there is such a column."""
    @F.pandas_udf("string")
    def cut(text: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, h) for t, h in zip(text, hits)], dtype=object)

    own = tuple(docs.columns)
    found = contamination(docs, benchmark, text_col=text_col, keep=own, **options).toDF(*[f"c{i}" for i in range(len(own))], "n_words", "hits", "items")
    text = f"c{own.index(text_col)}"
    found = found.withColumn(text, F.when(F.size("hits") > 0, cut(text, "hits")).otherwise(F.col(text)))
    chars = F.when(F.size("hits") > 0, F.length(text).cast("long"))
    return found.select(*[(F.coalesce(chars, F.col(f"c{i}")) if c == chars_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(own)])
