"""Toxicity from the nearest labelled examples: exact cosine of weighted TF-IDF vectors over a block-max inverted index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import StageArea
from .common import Chunk, alnum_words, annotate, chunks, column, give_back, lower, mix64, prefix_hash, ranges, raw, slice_hash, split_words, tidy, trim
from .ngram_join import shingle_sets

#: labelled rows of each class that the examples are taken from, at most (those with the smallest id hashes)
EXAMPLES = 3000
#: neighbours that vote
NEIGHBOURS = 15
#: Jaccard index of their 4-word shingles from which two examples of one class are copies
COPIES = 0.8
#: examples per block of the index
BLOCK = 256
#: terms that most examples have, whose postings are kept as a dense matrix
FREQUENT = 512
#: bytes of text whose terms are looked up together; many arrays of eight bytes a byte are alive then
LOOK_UP = 1 << 17
#: texts that are scored together
QUERIES = 64
#: terms with fewer postings than this share of the examples stay out of the matrix
OFTEN = 0.04
#: lengths of word beginnings that are terms beside whole words
STEMS = (4, 5, 6)


def terms_of(text: bytes) -> Counter:
    """Words and word beginnings (marked by ``*``) with their counts."""
    out: Counter = Counter()
    for word, n in Counter(split_words(text)).items():
        out[word] += n
        for k in STEMS:
            if len(word) > k:
                out[word[:k] + b"*"] += n
    return out


_STAR = np.uint64(0xA24BAED4963EE407)


def _beginnings(prefix: np.ndarray, a: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the words' first k bytes as terms."""
    return mix64(slice_hash(prefix, a, a + k) ^ _STAR)


class Vocabulary:
    """All terms of the examples with their weights; turns texts into unit vectors. Terms are told apart by 64-bit hashes."""

    def __init__(self, terms: pa.BinaryArray, idf: np.ndarray | None = None):
        self.terms, self.idf = terms, idf
        data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)
        at = np.frombuffer(terms.buffers()[1] or bytes(4), np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
        a, b = at[:-1], at[1:]
        prefix = prefix_hash(data)
        whole = data[np.maximum(b - 1, 0)] != ord("*") if len(a) else np.zeros(0, bool)
        hashes = np.where(whole, slice_hash(prefix, a, b), mix64(slice_hash(prefix, a, np.maximum(a, b - 1)) ^ _STAR))
        order = np.argsort(hashes)
        self.keys = np.append(hashes[order], ~np.uint64(0))  # the last one ends every look-up
        self.numbers = np.append(order, -1).astype(np.int32)
        bits = max(1, int(len(terms)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        #: by term: the beginnings of a word among the terms; -1 where it has none
        self.stems = np.full((len(STEMS), len(terms)), -1, np.int32)
        for line, k in zip(self.stems, STEMS):
            long = np.flatnonzero(whole & (b - a > k))
            line[long] = self.find(_beginnings(prefix, a[long], k))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the terms of these hashes, else -1."""
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        todo = np.flatnonzero(self.keys[at] < hashes)
        while len(todo):
            at[todo] += 1
            todo = todo[self.keys[at[todo]] < hashes[todo]]
        return np.where(self.keys[at] == hashes, self.numbers[at], -1)

    def counts(self, part: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the terms of each row, ascending within the row, how often each is in it, and each row's first place (n + 1)."""
        data = lower(part.data)
        a, b, first = alnum_words(data, part.starts)
        prefix, many = prefix_hash(data), max(1, len(self.terms))
        row = np.repeat(np.arange(len(part)), np.diff(first)) * many
        number = self.find(slice_hash(prefix, a, b))
        have = number >= 0
        known, rows = number[have], row[have]
        found = [rows + known]
        a, b, row = a[~have], b[~have], row[~have]
        for line, k in zip(self.stems, STEMS):
            stem = line[known]
            found.append(rows[stem >= 0] + stem[stem >= 0])
            long = b - a > k
            stem = self.find(_beginnings(prefix, a[long], k))
            found.append(row[long][stem >= 0] + stem[stem >= 0])
        every = np.concatenate(found)
        every.sort()
        fresh = np.flatnonzero(np.concatenate((np.ones(min(1, len(every)), bool), every[1:] != every[:-1])))
        each = every[fresh]
        return each % many, np.diff(np.append(fresh, len(every))), np.searchsorted(each, np.arange(len(part) + 1) * many)

    def weigh(self, which: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights of each row's terms, of unit length by row, and the lengths that they had before."""
        weight = (1 + np.log(counts.astype(np.float64))) * self.idf[which]
        size = np.diff(at)
        row = np.repeat(np.arange(len(size)), size)
        lengths = np.sqrt(np.bincount(row, weight**2, len(size)))
        return weight / lengths[row], lengths

    def vectors(self, part: Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
        which, counts, at = self.counts(part)
        weight, _ = self.weigh(which, counts, at)
        return [(which[i:j], weight[i:j]) for i, j in zip(at[:-1], at[1:])]


class BlockMaxIndex:
    """Postings by term, those of the up to FREQUENT terms of at least OFTEN of the examples also as a matrix in blocks of examples with each block's largest weight.

    Weights are positive, so what the other terms give is a lower bound of every score. A block is scored for the
    queries whose bound in it (these scores and the block's largest weights) reaches the k-th lower bound, so the
    result is exact.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK):
        which = np.concatenate([np.zeros(0, np.int32), *[w.astype(np.int32) for w, _ in vectors]])
        levels, kinds = np.unique(np.concatenate([np.zeros(0), *[w for _, w in vectors]]), return_inverse=True)
        self._fill(which, kinds + 1, [len(w) for w, _ in vectors], levels, np.ones(terms), np.ones(len(vectors)), block)

    @classmethod
    def of_counts(cls, which: np.ndarray, counts: np.ndarray, at: np.ndarray, idf: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> BlockMaxIndex:
        """Of examples with ``counts`` of the terms ``which``, example i from at[i] to at[i + 1]; lengths: of their vectors before they are scaled."""
        out = cls.__new__(cls)
        occur = np.bincount(counts) > 0
        codes = np.cumsum(occur).astype(np.min_scalar_type(int(occur.sum())))
        out._fill(which, codes[counts], np.diff(at), 1 + np.log(np.flatnonzero(occur)), idf, lengths, block)
        return out

    def _fill(self, term: np.ndarray, kinds: np.ndarray, sizes, levels: np.ndarray, by_term: np.ndarray, by_example: np.ndarray, block: int) -> None:
        """A posting's weight is levels[kind - 1] * by_term / by_example, so that it and a place of the matrix take a byte or a few."""
        self.block, self.size = block, len(by_example)
        self.blocks = -(-self.size // block)
        self.levels, self.by_term = np.concatenate(([0.0], levels)), by_term
        self.by_example = np.ones(self.blocks * block)
        self.by_example[: self.size] = by_example
        example = np.repeat(np.arange(self.size, dtype=np.min_scalar_type(max(0, self.size - 1))), sizes)
        held = np.bincount(term, minlength=len(by_term))
        often = np.argsort(-held, kind="stable")[: min(FREQUENT, int((held >= OFTEN * self.size).sum()))]
        self.row = np.full(len(by_term), -1, np.int16)
        self.row[often] = np.arange(len(often))
        self.often = often
        order = np.argsort(term, kind="stable")
        self.examples, self.kinds = example[order], kinds.astype(np.min_scalar_type(len(levels)))[order]
        self.cuts = np.concatenate(([0], np.cumsum(held))).astype(np.int32 if len(term) < 1 << 31 else np.int64)
        self.dense = self.tops = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": None, "tops": None}  # each task makes its own from the postings

    def _postings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms' postings, and how many each has."""
        count = self.cuts[which + 1] - self.cuts[which]
        return ranges(self.cuts[which], count), count

    def _matrix(self) -> None:
        """The kinds (0: none) of the terms of the matrix in all examples; it is turned into weights block by block."""
        if self.dense is None:
            self.dense = np.zeros((len(self.often), self.blocks * self.block), self.kinds.dtype)
            at, count = self._postings(self.often)
            self.dense[np.repeat(np.arange(len(self.often)), count), self.examples[at]] = self.kinds[at]
            self.tops = np.zeros((len(self.often), self.blocks))
            for b in range(self.blocks):
                here = slice(b * self.block, (b + 1) * self.block)
                self.tops[:, b] = (self.levels[self.dense[:, here]] / self.by_example[here]).max(axis=1, initial=0)

    def nearest_each(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k examples of largest positive cosine (ties: smallest number) and their cosines, for every query."""
        self._matrix()
        width = self.blocks * self.block
        scores = np.zeros((len(queries), width))
        often = np.zeros((len(queries), len(self.dense)))
        for q, (which, weight) in enumerate(queries):
            row = self.row[which]
            often[q, row[row >= 0]] = weight[row >= 0] * self.by_term[which[row >= 0]]
            which, weight = which[row < 0], weight[row < 0]
            at, count = self._postings(which)
            scores[q] = np.bincount(self.examples[at], np.repeat(weight * self.by_term[which], count) * self.levels[self.kinds[at]], width) / self.by_example
            if without is not None and without[q] >= 0:
                scores[q, without[q]] = -np.inf
        least = np.partition(scores, width - k, axis=1)[:, width - k] if k < width else np.full(len(queries), -np.inf)
        bounds = scores.reshape(len(queries), self.blocks, self.block).max(axis=2) + often @ self.tops
        for b in range(self.blocks):
            here = slice(b * self.block, (b + 1) * self.block)
            open_ = bounds[:, b] >= least - 1e-12
            scores[~open_, here] = 0
            if open_.any():
                scores[open_, here] += often[open_] @ self.levels[self.dense[:, here]] / self.by_example[here]
        out = []
        for line in np.round(scores, 12, out=scores):
            last = np.partition(line, width - k)[width - k] if k < width else 0.0
            found = np.flatnonzero((line > 0) & (line >= last))
            found = found[np.argsort(-line[found], kind="stable")][:k]
            out.append((found, line[found]))
        return out

    def nearest(self, which: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_each([(which, weight)], k, [without])[0]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone fit of y on x by pooling neighbours; each pool is drawn towards 1/2 by one row."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist()):
        pools.append([a, a, b * c, c])
        while len(pools) > 1 and (pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3] or pools[-2][1] == pools[-1][0]):
            _, to, s, t = pools.pop()
            pools[-1][1] = to
            pools[-1][2] += s
            pools[-1][3] += t
    level = np.maximum.accumulate([(s + 0.5) / (t + 1) for *_, s, t in pools])
    return np.array([v for p in pools for v in p[:2]]), np.repeat(level, 2)


def log_likelihood(c0: np.ndarray, c1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Log-likelihood ratio (G2) of terms that are in c0 of n0 and c1 of n1 examples."""
    out = np.zeros(len(c0))
    for a, b, n in ((c0, c1, n0), (c1, c0, n1), (n0 - c0, n1 - c1, n0), (n1 - c1, n0 - c0, n1)):
        have = a > 0
        out[have] += 2 * a[have] * np.log(a[have] * float(n0 + n1) / ((a[have] + b[have]) * float(n)))
    return np.maximum(out, 0.0)


@dataclass
class Model:
    """Everything a task needs: at most 2 * EXAMPLES examples over all their terms."""

    vocabulary: Vocabulary
    index: BlockMaxIndex
    labels: np.ndarray
    names: list[str]
    weights: np.ndarray
    neighbours: int
    prior: float
    knots: tuple[np.ndarray, np.ndarray]

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[float | None, np.ndarray]]:
        """Share of the distance-weighted votes for toxic, None if no example shares a term, and the voters."""
        out = []
        for at in range(0, len(queries), QUERIES):
            some = slice(at, at + QUERIES)
            for near, cosine in self.index.nearest_each(queries[some], self.neighbours, without and without[some]):
                votes = self.weights[self.labels[near]] / (1.02 - np.minimum(1.0, cosine))
                out.append((float((votes * self.labels[near]).sum() / votes.sum()) if len(near) else None, near))
        return out

    def scores(self, part: Chunk) -> list[tuple[float, list[str], list[str]]]:
        """Calibrated score, the nearest examples and the terms that stand for it."""
        out = []
        vectors = self.vocabulary.vectors(part)
        for (which, weight), (share, near) in zip(vectors, self.votes(vectors)):
            if share is None:
                out.append((self.prior, [], []))
                continue
            shown = [self.vocabulary.terms[i].as_py().decode(errors="replace") for i in which[np.argsort(-weight, kind="stable")[:5]].tolist()]
            out.append((float(np.interp(share, *self.knots)), [self.names[e] for e in near.tolist()], shown))
        return out


def _class_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            seen[label].update(terms_of(text.as_buffer().to_pybytes()).keys())
    every = list(seen[0].keys() | seen[1].keys())
    for at in range(0, len(every), 100_000):
        part = every[at : at + 100_000]
        counts = [pa.array([c[t] for t in part], pa.int64()) for c in seen]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), *counts], names=["term", "clean", "toxic"])


def _held_by(shared):
    """Document counts of the terms and, under -1, of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        total, rows = np.zeros(len(vocabulary.terms), np.int64), 0
        for batch in batches:
            for part in chunks(batch.column(0), LOOK_UP):
                rows += len(part)
                total += np.bincount(vocabulary.counts(part)[0], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, used)), pa.array(np.append(rows, total[used]))], names=["term", "n"])

    return run


def _picked(docs: DataFrame, known: DataFrame, examples: int) -> DataFrame:
    """Ids and text digests of the examples: equal texts of a class count once, by the smallest id hash."""
    texts = docs.select("doc_id", F.md5("body").alias("digest")).join(known, F.col("doc_id") == F.col("id"))
    once = texts.groupBy("label", "digest").agg(F.min(F.struct(F.xxhash64("id").alias("at"), "id")).alias("x"))
    picks = [once.filter(F.col("label") == c).orderBy("x", "digest").limit(examples) for c in (0, 1)]
    return picks[0].unionByName(picks[1]).select("x.at", "x.id", "digest", "label")


def apart(sets: list[np.ndarray], labels: list[int]) -> list[int]:
    """Places of the sets (distinct hashes each) without copies: those with a Jaccard index of COPIES or more with an
    earlier one of their label that was kept."""
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    order = np.argsort(flat).astype(np.int32)
    flat = flat[order]
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    held = np.append(np.flatnonzero(first), len(flat)).astype(np.int32)
    item = np.empty(len(flat), np.int32)
    item[order] = np.cumsum(first, dtype=np.int32) - 1
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order]
    del flat, order, first
    starts = np.concatenate(([0], np.cumsum(sizes)))
    label, kept = np.array(labels, np.int64), np.zeros(len(sets), bool)
    for i in range(len(sets)):
        mine = item[starts[i] : starts[i + 1]]
        both = np.bincount(owner[ranges(held[mine], held[mine + 1] - held[mine])], minlength=len(sets))
        copies = kept & (label == label[i]) & (both > 0) & (both >= COPIES * (sizes + sizes[i] - both))
        kept[i] = not copies.any()
    return np.flatnonzero(kept).tolist()


def _apart(chosen: DataFrame) -> DataFrame:
    """The examples without copies in their class, which would make all words of a text look telling."""

    def start():
        def work(texts: pa.Array) -> list[pa.Array]:
            out = []
            for part in chunks(texts):
                grams, at = shingle_sets(part, 4)
                out += [grams[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            return [pa.array(out, pa.binary())]

        return work

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets = [], []
        for batch in batches:
            for key, grams in zip(zip(*[batch.column(k).to_pylist() for k in range(4)]), batch.column(4)):
                if not keys or keys[-1] != key:  # rows that repeat id and text stand side by side
                    keys.append(key)
                    sets.append(np.frombuffer(grams.as_buffer().to_pybytes(), np.uint64))
        kept = [keys[i] for i in apart(sets, [k[0] for k in keys])]
        columns = [pa.array([k[i] for k in kept], t) for i, t in ((0, pa.int32()), (2, pa.string()), (3, pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["label", "name", "digest"])

    key = ("label", "at", "name", "digest")
    rows = annotate(chosen, start, "grams binary", "body", key).repartition(1).sortWithinPartitions(*key)  # at most 2 * examples
    kept = rows.mapInArrow(tidy(pick), "label int, name string, digest string")
    return chosen.join(F.broadcast(kept), ["label", "name", "digest"]).dropDuplicates(["label", "name", "digest"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> Model:
    """Learn from the rows of ``labels`` (id, label 0 or 1); the caller leaves out what must not be learned from.

    At most ``examples`` different texts of each class, those with the smallest hashes of their ids, are the examples,
    without near copies in their class, and all their words and word beginnings are terms. A term weighs its inverse document frequency
    (over all of ``docs``) times the root of one plus its log-likelihood ratio between the classes. Ids with several labels count as toxic if one says so;
    null labels and ids without a document are ignored. Without examples of both classes every score is the share of
    toxic labels, or 0.
    """
    spark = docs.sparkSession
    area = StageArea(spark, "toxicity")
    known = labels.select(column(id_col).alias("id"), column(label_col).cast("int").alias("label")).filter("label IN (0, 1) AND id IS NOT NULL")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    texts = docs.select(column(id_col).alias("doc_id"), raw(text_col).alias("body"))
    picked = area.save(_picked(texts, known, examples), "picked")  # at most 2 * examples rows
    chosen = texts.join(F.broadcast(picked), (F.col("doc_id") == F.col("id")) & (F.md5("body") == F.col("digest")))
    chosen = area.save(chosen.select("at", F.col("doc_id").cast("string").alias("name"), "digest", "body", "label"), "examples")

    chosen = area.save(_apart(chosen), "apart")
    give_back()

    seen = chosen.select("body", "label").mapInArrow(tidy(_class_terms), "term binary, clean long, toxic long")
    seen = seen.groupBy("term").agg(F.sum("clean").alias("c0"), F.sum("toxic").alias("c1"))
    size = {r.label: r.n for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        nothing = BlockMaxIndex([], 0)
        return Model(Vocabulary(pa.array([], pa.binary()), np.zeros(0)), nothing, np.zeros(0, np.int64), [], np.ones(2), neighbours, prior, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))

    table = seen.toArrow().sort_by("term")  # at most the terms of 2 * examples documents
    terms = table.column("term").combine_chunks().cast(pa.binary())
    vocabulary = Vocabulary(terms)
    telling = log_likelihood(table.column("c0").to_numpy(), table.column("c1").to_numpy(), size[0], size[1])
    del table
    give_back()

    shared = spark.sparkContext.broadcast(vocabulary)
    held = docs.select(raw(text_col)).mapInArrow(tidy(_held_by(shared)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms) + 1)
    df[held.column("term").to_numpy()] = held.column("n").to_numpy()  # the number of documents is the last
    vocabulary.idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * np.sqrt(1 + telling)
    del held, df, telling

    def count():
        def work(texts: pa.Array) -> list[pa.Array]:
            out: tuple[list[bytes], list[bytes]] = ([], [])
            for part in chunks(texts, LOOK_UP):
                which, counts, at = shared.value.counts(part)
                for i, j in zip(at[:-1], at[1:]):
                    out[0].append(which[i:j].astype(np.int32).tobytes())
                    out[1].append(counts[i:j].astype(np.int32).tobytes())
            return [pa.array(x, pa.binary()) for x in out]

        return work

    table = annotate(chosen, count, "which binary, counts binary", "body", ("name", "label", "digest")).toArrow()  # at most 2 * examples documents' terms
    shared.destroy()
    table = table.sort_by([("name", "ascending"), ("label", "ascending"), ("digest", "ascending")])
    lengths = pc.binary_length(table.column("which")).to_numpy() // 4
    every = table.column("label").to_numpy().astype(np.int64)
    empty, y = every[lengths == 0].tolist(), every[lengths > 0]
    names = [n for n, k in zip(table.column("name").to_pylist(), lengths.tolist()) if k]
    which, counts = (np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(x.as_buffer(), np.int32) for x in table.column(k)]]) for k in ("which", "counts"))
    del table
    at = np.concatenate(([0], np.cumsum(lengths[lengths > 0])))
    weight, sizes = vocabulary.weigh(which, counts, at)
    vectors = [(which[i:j], weight[i:j]) for i, j in zip(at[:-1], at[1:])]
    weights = np.array([totals[c] / size[c] for c in (0, 1)])  # a class that was cut down votes for what was cut
    bare = np.array([weights[c] for c in empty]) if empty else np.ones(1)
    unknown = float((bare * np.array(empty or [0])).sum() + 0.5 * prior) / float(bare.sum() + 1)
    give_back()
    index = BlockMaxIndex.of_counts(which, counts, at, vocabulary.idf, sizes)
    del counts
    give_back()
    model = Model(vocabulary, index, y, names, weights, neighbours, unknown, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    left = [share for share, _ in model.votes(vectors, list(range(len(vectors))))]
    index.dense = index.tops = None
    have = np.array([i for i, s in enumerate(left) if s is not None], np.int64)
    if len(have):
        model.knots = isotonic(np.array([left[i] for i in have]), y[have].astype(float), weights[y[have]])
    return model


def toxicity(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``score`` of every row (0 to 1), ids of the nearest examples and the terms of the text that were found in them.

    A text without terms of the model, null and empty ones among them, gets the toxic share of such examples. Rows
    are scored one by one from their texts alone; repeated rows get equal scores, an empty table an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        held = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = []
            for part in chunks(texts, LOOK_UP):
                rows += held.scores(part)
            trim()
            kinds = (pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
            return [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]

        return work

    return annotate(docs, start, "score double, nearest array<string>, terms array<string>", text_col, keep)


def held_out(key: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels.filter(~held_out(column("doc_id"))))


THRESHOLD = 0.7


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = toxicity(docs, learned(docs, labels), keep=("doc_id",))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "nearest",
        "terms",
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold."""
    own = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(own))])
    scored = toxicity(inner, learned(docs, labels), f"c{own.index('text')}")
    return scored.filter(F.col("score") < THRESHOLD).drop("score", "nearest", "terms").toDF(*own)
