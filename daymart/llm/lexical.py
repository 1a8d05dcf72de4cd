"""Ranked lexical search: best-first search of document intervals, bounded by range maxima over the posting lists.

Documents are dealt into shards. In a shard every query term has a posting list in document order with the impact (what
the term adds to the score) of each posting, and a sparse table answers which posting of a range has the largest
impact. An interval of documents can't hold a score above the sum of its terms' range maxima. The intervals with the
largest bounds are split first, at the document of the largest single impact, which is scored; what can't reach the
k-th score any more is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..session import StageArea
from .common import alnum_words, chunks, column, lower, plain, prefix_hash, raw, slice_hash, tidy

#: query terms with repeats that one search takes; more queries are searched in several passes
BLOCK_TERMS = 1_000_000
#: postings of one shard, about; a longer document is a shard of its own
SHARD_POSTINGS = 1 << 20
#: (interval, term) pairs of one step
STEP = 1 << 13
#: tasks whose answers are merged first
FAN_IN = 64

# Fixed values of the score: share of a length in it, saturation, and the scale of a term's part.
LENGTH_SHARE, SATURATION, SCALE = 75, 8, 1_000_000_000


def term_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all terms of a chunk (letters, digits, non-ASCII; A-Z in lower case), and each row's first."""
    data = lower(data)
    a, b, first = alnum_words(data, starts)
    return slice_hash(prefix_hash(data), a, b), first


@dataclass(frozen=True)
class Queries:
    """A block of queries: the sorted hashes of their terms, and per query its term numbers and how often each occurs."""

    ids: tuple
    terms: np.ndarray
    offsets: np.ndarray
    term: np.ndarray
    times: np.ndarray


def _block(ids: list, hashes: list[np.ndarray]) -> Queries:
    terms = np.unique(np.concatenate(hashes))
    lists = [np.unique(np.searchsorted(terms, h), return_counts=True) for h in hashes]
    return Queries(tuple(ids), terms, np.cumsum([0, *(len(t) for t, _ in lists)]), np.concatenate([t for t, _ in lists]), np.concatenate([c for _, c in lists]))


def query_blocks(queries: DataFrame, id_col: str, text_col: str, block_terms: int) -> Iterator[Queries]:
    """The queries in blocks of about ``block_terms`` terms; they are streamed and never held whole. Queries without
    terms are left out."""
    ids: list = []
    hashes: list[np.ndarray] = []
    held = 0
    for key, text in queries.select(column(id_col), raw(text_col)).toLocalIterator():
        data = np.frombuffer(bytes(text), np.uint8)
        h, _ = term_hashes(data, np.array([0, len(data)], np.int64))
        if len(h):
            ids.append(key)
            hashes.append(h)
            held += len(h)
        if held >= block_terms:
            yield _block(ids, hashes)
            ids, hashes, held = [], [], 0
    if ids:
        yield _block(ids, hashes)


def _postings(block: Queries):
    """Rows (doc_id, text) to (doc_id, n, terms, tfs): the number of all terms, and the query terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(1)):
                hashes, first = term_hashes(part.data, part.starts)
                at = np.minimum(np.searchsorted(block.terms, hashes), len(block.terms) - 1)
                known = np.flatnonzero(block.terms[at] == hashes)
                doc = np.searchsorted(first, known, side="right") - 1
                pair, tf = np.unique(doc * len(block.terms) + at[known], return_counts=True)
                doc, term = pair // len(block.terms), (pair % len(block.terms)).astype(np.int32)
                cut = pa.array(np.searchsorted(doc, np.arange(len(part) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(x, pa.int32())) for x in (term, tf.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, len(part)), pa.array(np.diff(first), pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


class Shard:
    """Posting lists of documents 0 to n - 1 with impacts, and one sparse table over all lists side by side.

    ``best[j][i]`` is the place of the largest of the 2 ** j impacts from place i on, the first one of equals; only
    ranges within one list are asked for.
    """

    def __init__(self, n: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        self.n = n
        key = term.astype(np.int64) * n + doc
        order = np.argsort(key, kind="stable")
        self.key, self.doc, self.impact = key[order], doc[order], impact[order]
        bounds = np.searchsorted(self.key, np.arange(terms + 1, dtype=np.int64) * n)
        self.size = np.diff(bounds)
        longest = int(self.size.max(initial=0))
        self.best = [np.arange(len(key), dtype=np.int32)]
        while 2 << (len(self.best) - 1) <= longest:
            below, half = self.best[-1], 1 << (len(self.best) - 1)
            left, right = below[:-half], below[half:]
            self.best.append(np.where(self.impact[left] >= self.impact[right], left, right))
        widths = np.zeros((len(self.best), len(key)), np.int32)
        for j, row in enumerate(self.best):
            widths[j, : len(row)] = row
        self.best = widths

    def place(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """First place in each term's list (rows) whose document is each of ``doc`` (columns) or later."""
        return np.searchsorted(self.key, term[:, None].astype(np.int64) * self.n + doc[None, :])

    def largest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and impact of the largest posting in the ranges [a, b); impact 0 for empty ranges."""
        size = b - a
        some = size > 0
        level = np.frexp(np.maximum(size, 1))[1] - 1
        a = np.minimum(a, len(self.key) - 1)
        left, right = self.best[level, a], self.best[level, np.where(some, b - (1 << level), a)]
        at = np.where(self.impact[left] >= self.impact[right], left, right)
        return at, np.where(some, self.impact[at], 0)

    def search(self, term: np.ndarray, times: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores above 0 and documents of the k best, ties by document; those below ``floor`` may be missing."""
        held = self.size[term] > 0
        term, times = term[held], times[held, None]
        score, doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(term):
            return score, doc
        step = max(1, STEP // len(term))
        lo, hi = np.zeros(1, np.int64), np.full(1, self.n, np.int64)
        bound, at = self._bounds(times, self.place(term, lo), self.place(term, hi))
        while len(lo):
            turn = np.argpartition(-bound, step)[:step] if len(bound) > step else np.arange(len(bound))
            turn = turn[np.argsort(lo[turn])]
            l, h, d = lo[turn], hi[turn], at[turn]
            # score the documents that split the intervals
            begin, middle, end = self.place(term, l), self.place(term, d), self.place(term, h)
            inside = np.minimum(middle, len(self.key) - 1)
            has = (middle < end) & (self.doc[inside] == d)
            found = (np.where(has, self.impact[inside], 0) * times).sum(axis=0)
            score, doc = np.concatenate((score, found)), np.concatenate((doc, d))
            top = np.lexsort((doc, -score))[:k]
            score, doc = score[top], doc[top]
            full = len(score) == k
            least = max(floor, int(score[-1]) if full else 1)
            # what is left and right of them
            left, left_at = self._bounds(times, begin, middle)
            right, right_at = self._bounds(times, middle + has, end)
            rest = np.ones(len(lo), bool)
            rest[turn] = False
            bound = np.concatenate((bound[rest], left, right))
            at = np.concatenate((at[rest], left_at, right_at))
            lo, hi = np.concatenate((lo[rest], l, d + 1)), np.concatenate((hi[rest], d, h))
            open_ = bound >= least
            if full and score[-1] == least:  # an equal score counts only before the last one's document
                open_ &= (bound > least) | (lo < doc[-1])
            bound, at, lo, hi = bound[open_], at[open_], lo[open_], hi[open_]
        good = score >= max(floor, 1)
        return score[good], doc[good]

    def _bounds(self, times: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bound of each interval (columns), and the document of its largest single impact."""
        place, impact = self.largest(a, b)
        impact = impact * times
        row = impact.argmax(axis=0)
        return impact.sum(axis=0), self.doc[place[row, np.arange(len(row))]]


def _search(block: Queries, weights: np.ndarray, k: int, id_type: pa.DataType):
    """Rows (doc_id, m, terms, tfs) to (part, item, doc_id, score): per shard the documents that may be among the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        floors = np.zeros(len(block.ids), np.int64)
        best: list[np.ndarray] = [np.zeros(0, np.int64)] * len(block.ids)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def answers() -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0] for x in held])
            m, size, term, tf = (np.concatenate([x[i] for x in held]) for i in range(1, 5))
            order = pc.sort_indices(pc.fill_null(ids, "") if pa.types.is_string(ids.type) else ids, null_placement="at_start").to_numpy()
            turn = np.empty(len(order), np.int64)
            turn[order] = np.arange(len(order))
            ids = ids.take(pa.array(order))
            owner = np.repeat(np.arange(len(size)), size)
            impact = weights[term] * (SCALE * tf // (1000 * tf + SATURATION * m[owner]))
            shard = Shard(len(ids), turn[owner], term, impact, len(block.terms))
            items, docs, scores = [], [], []
            for i in range(len(block.ids)):
                own = slice(block.offsets[i], block.offsets[i + 1])
                score, doc = shard.search(block.term[own], block.times[own], k, int(floors[i]))
                items.append(np.full(len(doc), i, np.int32))
                docs.append(doc)
                scores.append(score)
                best[i] = np.sort(np.concatenate((best[i], score)))[-k:]
                if len(best[i]) == k:
                    floors[i] = best[i][0]
            out = [np.concatenate(x) for x in (items, docs, scores)]
            columns = [pa.array(np.full(len(out[0]), part, np.int32)), pa.array(out[0]), ids.take(pa.array(out[1])), pa.array(out[2])]
            return pa.RecordBatch.from_arrays(columns, names=["part", "item", "doc_id", "score"])

        postings = 0
        for batch in batches:
            lo, sizes = 0, np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
            ends = np.cumsum(sizes)
            while lo < batch.num_rows:  # a batch may be cut between two shards
                room = SHARD_POSTINGS - postings + (int(ends[lo - 1]) if lo else 0)
                hi = max(lo + (0 if held else 1), int(np.searchsorted(ends, room, side="right")))
                if hi > lo:
                    rows = batch.slice(lo, hi - lo)
                    flat = [rows.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3)]
                    held.append((rows.column(0), rows.column(1).to_numpy(), sizes[lo:hi], *flat))
                    postings += int(sizes[lo:hi].sum())
                    lo = hi
                if lo < batch.num_rows or postings >= SHARD_POSTINGS:
                    yield answers()
                    held.clear()
                    postings = 0
        if held:
            yield answers()

    return run


def _one_block(spark: SparkSession, docs: DataFrame, block: Queries, k: int, id_field: StructField, area: StageArea, name: str) -> DataFrame:
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("n long, terms array<int>, tfs array<int>").fields])
    postings, seen = area.save_observed(docs.mapInArrow(tidy(_postings(block)), schema), name, docs=F.count_if(F.col("n") > 0), terms=F.sum("n"))
    # one row per term of the block at most
    held = np.zeros(len(block.terms), np.int64)
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[r.term] = r["count"]
    n, total = seen["docs"], seen["terms"] or 1
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(df) + 1))) for df in held], np.int64)
    # the product may pass 64 bits
    length = F.expr(f"cast({100 - LENGTH_SHARE} + (cast({LENGTH_SHARE} * n as decimal(24, 0)) * {n}BD div {total}BD) as long)")
    lists = postings.filter("size(terms) > 0").select("doc_id", length.alias("m"), "terms", "tfs")
    found_schema = StructType([*StructType.fromDDL("part int, item int").fields, docs.schema["doc_id"], *StructType.fromDDL("score long").fields])
    found = lists.mapInArrow(tidy(_search(block, weights, k, to_arrow_type(docs.schema["doc_id"].dataType))), found_schema)
    order = [F.desc("score"), F.asc("doc_id")]
    near = Window.partitionBy("item", F.floor(F.col("part") / FAN_IN)).orderBy(*order)
    some = found.select("*", F.row_number().over(near).alias("r")).filter(F.col("r") <= k).drop("r")
    ranked = some.select("*", F.row_number().over(Window.partitionBy("item").orderBy(*order)).alias("rank")).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, key) for i, key in enumerate(block.ids)], StructType([StructField("item", ranked.schema["item"].dataType), id_field]))
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id_col: str = "item_id",
    query_text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The k best documents of each query: item_id, rank (from 1), doc_id, score; scores are above 0.

    A term's weight w is floor(1000 * ln((2N + 2) / (2df + 1))); a document's length m is 25 + (75 * n * N) div L; a
    score sums w * ((10**9 * tf) div (1000 * tf + 8 * m)) over the query's terms with repeats. Terms are told apart by
    64-bit hashes. Equal scores are ordered by ascending doc_id, null first. Null and empty texts have no terms: such
    documents count for nothing, such queries have no rows. Rows are documents and queries of their own, so those that
    repeat an id are ranked one by one. Texts may have any length. Other columns are ignored. An empty table on either
    side gives no rows. The driver holds one block of queries and a count per term of it.
    """
    spark = docs.sparkSession
    area = StageArea(spark, "lexical")
    source = plain(docs, id_col, text_col)
    id_field = StructField("item_id", queries.schema[query_id_col].dataType)
    out = None
    for i, block in enumerate(query_blocks(queries, query_id_col, query_text_col, block_terms)):
        part = _one_block(spark, source, block, k, id_field, area, f"postings-{i:04d}")
        out = part if out is None else out.unionByName(part)
    if out is None:
        schema = StructType([id_field, *StructType.fromDDL("rank int").fields, source.schema["doc_id"], *StructType.fromDDL("score long").fields])
        return spark.createDataFrame([], schema)
    return out
