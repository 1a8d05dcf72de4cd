"""N-gram Jaccard join by vertical partitioning: a global n-gram order, prefixes for candidates, partial overlaps per
fragment of the order, one sum per pair."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.retrieval import components
from ..session import StageArea
from .common import Chunk, body, chunks, column, lower, mix64, plain, prefix_hash, ranges, raw, slice_hash, space_words, tidy

#: n-grams are counted in 2 ** SKETCH_BITS cells; a cell's count, in steps of 2 ** (1/8), is the first order key
SKETCH_BITS = 22
SLICES = 256
#: 64-bit words of a set's parity map
MAP_WORDS = 16
#: rounds in which the classes of an n-gram that more than SMALL share are compared with HUBS of them
ROUNDS, HUBS, SMALL = 2, 4, 32
#: pieces of the global order; a pair's overlap is counted in each on its own
FRAGMENTS = 8
#: a list of documents to fetch that is broadcast; a longer one is joined
FETCH_ROWS = 200_000

_MAP = [f"m{k}" for k in range(MAP_WORDS)]
_CELL = np.uint64(64 - SKETCH_BITS)


def _weights(width: int) -> np.ndarray:
    return mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingle_sets(part: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row of a chunk, ascending within the row, and each row's first place (n + 1).

    A row with fewer than ``width`` words, but not none, has its whole word sequence as one n-gram.
    """
    a, b, first = space_words(lower(part.data), part.starts)
    words = slice_hash(prefix_hash(lower(part.data)), a, b)
    size = np.diff(first)
    count = np.where(size >= width, size - width + 1, np.minimum(size, 1))
    w = _weights(width)
    n = max(0, len(words) - width + 1)
    rolled = reduce(add, [words[k : k + n] * w[k] for k in range(width)]) if n else np.zeros(0, np.uint64)
    hashes = np.zeros(int(count.sum()), np.uint64)
    out = np.concatenate(([0], np.cumsum(count)))
    whole = size >= width
    hashes[ranges(out[:-1][whole], count[whole])] = mix64(rolled[ranges(first[:-1][whole], count[whole])] + np.uint64(width))
    for i in np.flatnonzero((size > 0) & ~whole):
        hashes[out[i]] = mix64((words[first[i] : first[i + 1]] * w[: size[i]]).sum(dtype=np.uint64, keepdims=True) + np.uint64(size[i]))[0]
    row = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((hashes, row))
    hashes = hashes[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[fresh], np.concatenate(([0], np.cumsum(np.bincount(row[fresh], minlength=len(count)))))


def _digests(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(hashes * np.uint64(0xE7037ED1A0B428DB)))))
    return mix64(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def _maps(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Parity of the members in each of 1024 cells: two maps differ in at most as many bits as the sets differ in members."""
    n = len(at) - 1
    cells = 64 * MAP_WORDS
    row = np.repeat(np.arange(n), np.diff(at))
    bit = ((hashes * np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(40)).astype(np.int64) % cells
    odd = (np.bincount(row * cells + bit, minlength=n * cells) & 1).astype(np.uint8).reshape(n, cells)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def _profile(width: int):
    """Rows of documents (doc_id, n, digest, map) and, at a task's end, its n-gram counts in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        waiting: list[np.ndarray] = []

        def count() -> None:
            if waiting:
                counts[:] += np.bincount(np.concatenate(waiting), minlength=len(counts)).astype(np.uint32)
                waiting.clear()

        names = ["doc_id", "mark", "n", "digest", *_MAP, "slice", "cells"]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in chunks(batch.column(2)):
                hashes, at = shingle_sets(part, width)
                waiting.append((hashes >> _CELL).astype(np.uint32))
                if sum(map(len, waiting)) > len(counts) // 4:
                    count()
                maps = _maps(hashes, at)
                out = [batch.column(k).slice(part.lo, len(part)) for k in (0, 1)]
                out += [pa.array(np.diff(at).astype(np.int32)), pa.array(_digests(hashes, at))]
                out += [pa.array(np.ascontiguousarray(maps[:, k])) for k in range(MAP_WORDS)]
                none = len(part)
                yield pa.RecordBatch.from_arrays([*out, pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names=names)
        if id_type is not None:
            count()
            pieces = counts.reshape(SLICES, -1)
            used = np.flatnonzero(pieces.any(axis=1))
            none = len(used)
            out = [pa.nulls(none, id_type), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32()), *[pa.nulls(none, pa.int64())] * (1 + MAP_WORDS)]
            data = [zlib.compress(pieces[k].astype("<u4").tobytes(), 1) for k in used]
            yield pa.RecordBatch.from_arrays([*out, pa.array(used.astype(np.int32)), pa.array(data, pa.binary())], names=names)

    return run


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(data), "<u4").astype(np.uint64)
            total[k] = total[k] + part if k in total else part
    # an order key of one byte a cell is all that the driver gets
    data = [np.minimum(255, np.round(8 * np.log2(x + 1.0))).astype(np.uint8).tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(data, pa.binary())], names=["slice", "cells"])


def _prefixes(width: int, percent: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        seen: set[int] = set()  # a task sends equal sets once
        for batch in batches:
            for part in chunks(batch.column(0)):
                hashes, at = shingle_sets(part, width)
                digests = _digests(hashes, at)
                n = np.diff(at)
                row = np.repeat(np.arange(len(n)), n)
                turn = np.lexsort((hashes, rank[(hashes >> _CELL).astype(np.int64)], row))
                size = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                for i, d in enumerate(digests.tolist()):
                    if d in seen:
                        size[i] = 0
                    seen.add(d)
                keys = hashes[turn[ranges(at[:-1], size)]].view(np.int64)
                some = np.flatnonzero(size)
                offsets = np.concatenate(([0], np.cumsum(size[some]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(digests[some]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))], names=["digest", "prefix"])

    return run


def _fragments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(0)):
                hashes, at = shingle_sets(part, width)
                piece = (hashes >> np.uint64(61)).astype(np.int64)  # ascending within a row
                row = np.repeat(np.arange(len(at) - 1), np.diff(at))
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (piece[1:] != piece[:-1]))))
                offsets = np.append(first, len(row)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_digests(hashes, at)[row[first]]), pa.array(piece[first].astype(np.int32)), lists], names=["digest", "fragment", "grams"]
                )

    return run


class NgramJoin:
    """Jaccard links between the n-gram sets of documents, and their components.

    Equal sets form one class. A class's prefix holds its first n-grams in the global order (rare cells first): two
    sets with enough overlap share one of them. Classes that share a prefix n-gram are candidates if their sizes and
    parity maps allow the similarity; both tests are bounds and lose no link. Candidates are compared with the
    smallest class of their n-gram first, then those of common n-grams with a few more of them. Only classes that these
    links leave in different components are compared with each other after that, so a large group of near copies is
    never expanded into all its pairs, and no link between components is lost.
    """

    def __init__(self, docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = docs.sparkSession
        self.width, self.percent = width, percent
        self.area = StageArea(self.spark, "ngram-join")
        self.texts = docs.select(column(id_col).alias("doc_id"), body(text_col).alias("body"))
        source = plain(docs, id_col, text_col).select("doc_id", F.xxhash64("body").alias("mark"), "body")
        kind = source.schema["doc_id"].dataType.simpleString()
        maps = ", ".join(f"{m} long" for m in _MAP)
        scanned = self.area.save(source.mapInArrow(tidy(_profile(width)), f"doc_id {kind}, mark long, n int, digest long, {maps}, slice int, cells binary"), "profiles")
        self.members = scanned.filter("slice IS NULL").select("doc_id", "mark", "n", "digest", *_MAP)
        cells = scanned.filter("slice IS NOT NULL").select("slice", "cells").repartition("slice").mapInArrow(tidy(_add_slices), "slice int, cells binary")
        order = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8)
        for r in cells.toLocalIterator():  # 2 ** SKETCH_BITS bytes, whatever the input
            order[r.slice] = np.frombuffer(r.cells, np.uint8)
        self.order = self.spark.sparkContext.broadcast(order.ravel())
        self.classes = self.area.save(
            self.members.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), *[F.first(m).alias(m) for m in _MAP]), "classes"
        )

    def _entries(self) -> DataFrame:
        """(gram, digest, hub) of the prefix n-grams that several classes share; hub is the smallest of them."""
        rows = self.texts.select(F.col("body").cast("binary")).mapInArrow(tidy(_prefixes(self.width, self.percent, self.order)), "digest long, prefix array<long>")
        same = Window.partitionBy("gram")
        rows = rows.select("digest", F.explode("prefix").alias("gram"))
        rows = rows.select("gram", "digest", F.min("digest").over(same).alias("hub"), F.max("digest").over(same).alias("top"))
        return rows.filter("hub <> top").select("gram", "digest", "hub").dropDuplicates(["gram", "digest"])

    def _sizes_allow(self, n: Column, m: Column) -> Column:
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def _maps_allow(self, a: str, b: str, n: Column, m: Column) -> Column:
        """A bound: overlap o of a link has (100 + p) o >= p (n + m), so at most (100 - p) / (100 + p) (n + m) members differ."""
        apart = reduce(add, [F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in _MAP])
        return apart * (100 + self.percent) <= (100 - self.percent) * (n + m)

    def _verify(self, pairs: DataFrame, tag: str) -> tuple[DataFrame, int]:
        """The pairs (a, b) of digests that are links, by exact overlaps, and their number."""
        pairs, seen = self.area.save_observed(pairs, f"pairs-{tag}", n=F.count(F.lit(1)))
        if not seen["n"]:
            return pairs, 0
        sides = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct().join(self.classes.select("digest", "rep"), "digest")
        sides, listed = self.area.save_observed(sides, f"wanted-{tag}", n=F.count(F.lit(1)))
        ids = sides.select("rep").distinct()
        ids = F.broadcast(ids) if listed["n"] <= FETCH_ROWS else ids
        fetched = self.texts.join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select(F.col("body").cast("binary"))
        grams = self.area.save(fetched.mapInArrow(tidy(_fragments(self.width)), "digest long, fragment int, grams array<long>"), f"fragments-{tag}")
        left = grams.select(F.col("digest").alias("a"), "fragment", F.col("grams").alias("x"))
        right = grams.select(F.col("digest").alias("b"), "fragment", F.col("grams").alias("y"))
        few = F.broadcast(pairs) if seen["n"] <= FETCH_ROWS else pairs  # then the left side stays where it is
        partial = few.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "fragment", F.size(F.array_intersect("x", "y")).alias("shared"))
        # an id that several rows of one text bear is fetched as often
        overlap = partial.groupBy("a", "b", "fragment").agg(F.max("shared").alias("shared")).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
        sizes = self.classes.select("digest", "n")
        both = overlap.join(sizes.toDF("a", "n"), "a").join(sizes.toDF("b", "m"), "b")
        links = both.filter(100 * F.col("shared") >= self.percent * (F.col("n") + F.col("m") - F.col("shared"))).select("a", "b")
        links, found = self.area.save_observed(links, f"links-{tag}", n=F.count(F.lit(1)))
        for name in ("pairs", "wanted", "fragments"):  # nothing reads them any more
            self.area.drop(f"{name}-{tag}")
        self.area.release()
        return links, found["n"]

    def _labels(self, links: DataFrame, known: DataFrame | None) -> DataFrame:
        """(digest, component) of the linked classes; ``known`` are the labels by the links before these."""
        edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        edges = edges if known is None else edges.unionByName(known.select(F.col("digest").alias("src"), F.col("component").alias("dst")))
        return components(self.spark, edges).select(F.col("id").alias("digest"), "component")

    def links(self) -> DataFrame:
        """Links (a, b) between classes (digests), enough of them to span every component."""
        return self._linked()[0]

    def _linked(self) -> tuple[DataFrame, DataFrame]:
        """Links and the labels (digest, component) by them. A step that has nothing to do, or found nothing, starts no jobs."""
        entries = self.area.save(self._entries(), "entries")
        self.area.release()
        star = entries.filter("digest <> hub").select(F.col("hub").alias("a"), F.col("digest").alias("b")).distinct()
        links, n = self._verify(self._plausible(star).select("a", "b"), "hubs")
        label = self._labels(links, None) if n else links.select(F.col("a").alias("digest"), F.col("b").alias("component"))
        left, seen = self._open(entries.filter("digest <> hub"), label, "open-0")
        self.area.drop("entries")
        for k in range(ROUNDS):  # components only grow, so each round goes on with what the one before left open
            if (seen["largest"] or 0) <= SMALL:
                break
            held = left.filter(F.col("size") > SMALL)
            hubs = F.array(*[F.min_by("digest", F.xxhash64("digest", F.lit(HUBS * k + j))).over(Window.partitionBy("gram")) for j in range(HUBS)])
            star = held.select(F.col("digest").alias("b"), F.col("component").alias("of_b"), F.array_distinct(hubs).alias("hubs"))
            star = star.select("b", "of_b", F.explode("hubs").alias("a")).distinct()
            star = self._plausible(star.join(held.select(F.col("digest").alias("a"), F.col("component").alias("of_a")).distinct(), "a").filter("of_a <> of_b").select("a", "b"))
            more, n = self._verify(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"hubs-{k}")
            if n:
                links, label = links.unionByName(more), self._labels(more, label)
                left, seen = self._open(left, label, f"open-{k + 1}")
                self.area.drop(f"open-{k}")
        if not seen["n"]:
            return links, label
        # what is still apart is compared member by member
        held = self.area.save(left.select("gram", "digest", "component").join(self.classes.drop("rep"), "digest"), "open")
        rest = held.alias("x").join(
            held.alias("y"),
            (F.col("x.gram") == F.col("y.gram")) & (F.col("x.digest") < F.col("y.digest")) & (F.col("x.component") != F.col("y.component"))
            & self._sizes_allow(F.col("x.n"), F.col("y.n"))
            & self._maps_allow("x", "y", F.col("x.n"), F.col("y.n")),
        )
        more, n = self._verify(rest.select(F.col("x.digest").alias("a"), F.col("y.digest").alias("b")).distinct(), "rest")
        return (links.unionByName(more), self._labels(more, label)) if n else (links, label)

    def _plausible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and maps allow a link; maps travel only where the sizes do."""
        own, sizes = self.classes.drop("rep", "n"), self.classes.select("digest", "n")
        pairs = pairs.select("a", "b").join(sizes.toDF("a", "n"), "a").join(sizes.toDF("b", "m"), "b").filter(self._sizes_allow(F.col("n"), F.col("m")))
        pairs = pairs.join(own.alias("x"), F.col("a") == F.col("x.digest")).join(own.alias("y"), F.col("b") == F.col("y.digest"))
        return pairs.filter(self._maps_allow("x", "y", F.col("n"), F.col("m")))

    def _open(self, entries: DataFrame, label: DataFrame, tag: str) -> tuple[DataFrame, dict]:
        """Entries of the n-grams whose classes are still in several components, with component and number of classes;
        their number and the largest number of classes.

        A class stays only if one next to it by size is near enough in size; else no class of the n-gram is.
        """
        held = entries.select("gram", "digest").join(label, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
        held = held.join(self.classes.select("digest", "n"), "digest")
        same = Window.partitionBy("gram")
        by_size = same.orderBy("n", "digest")
        held = held.withColumns({"low": F.min("component").over(same), "high": F.max("component").over(same), "size": F.count("*").over(same)})
        held = held.withColumns({"less": F.lag("n").over(by_size), "more": F.lead("n").over(by_size)})
        near = self._sizes_allow(F.col("n"), F.coalesce("less", F.lit(0))) | self._sizes_allow(F.col("n"), F.coalesce("more", F.lit(0)))
        held = held.filter((F.col("low") != F.col("high")) & near).select("gram", "digest", "component", "size")
        return self.area.save_observed(held, tag, n=F.count(F.lit(1)), largest=F.max("size"))

    def _joined(self) -> DataFrame:
        label = self._linked()[1]
        return self.classes.select("digest", "rep").join(label, "digest", "left").withColumn("component", F.coalesce("component", "digest"))

    def keepers(self) -> DataFrame:
        """(doc_id, mark) of the row that stands for each component: the smallest id; mark is the text's hash."""
        rows = self.members.filter("n > 0").join(self._joined().select("digest", "component"), "digest")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
        return rows.groupBy("component").agg(first).select("first.doc_id", "first.mark")

    def components(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, digest) of every row."""
        joined = self._joined()
        smallest = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
        by_class = joined.join(smallest, "component").select("digest", "component_id")
        some = self.members.filter("n > 0").join(by_class, "digest")
        none = self.members.filter("n = 0").withColumn("component_id", F.col("doc_id"))
        wanted = ["doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "digest"]
        return some.select(*wanted).unionByName(none.select(*wanted))


def ngram_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row its number of distinct n-grams and the smallest id reachable over links.

    Words stand between ASCII white space, A-Z in lower case. Sets link when 100 times the intersection is at least
    ``percent`` times the union. Texts without words, null ones among them, have an empty set and link with nothing.
    Rows with equal sets are linked; a null id is reported only where a component has no other. Repeated ids are
    rows of their own. An empty table gives an empty result. N-grams are told apart by 64-bit hashes.
    """
    return NgramJoin(docs, width, percent, id_col, text_col).components().drop("digest")


def one_per_group(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every component: the one with the smallest id, a repeated row once. Rows without words
    are in no group and all stay."""
    own = docs.columns
    inner = docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(own)], column(id_col).alias("doc_id"), F.xxhash64(raw(text_col)).alias("mark"))
    words = F.col(f"c{own.index(text_col)}").rlike(r"[^\x20\x09-\x0D]")
    keep = NgramJoin(docs, width, percent, id_col, text_col).keepers()
    keep = keep.withColumnsRenamed({"doc_id": "id", "mark": "m"})
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m"))
    grouped = inner.filter(words).join(keep, same, "left_semi").dropDuplicates(["doc_id", "mark"])
    return grouped.unionByName(inner.filter(~F.coalesce(words, F.lit(False)))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
