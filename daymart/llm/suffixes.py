"""Removal of repeated byte strings by range-partitioned suffix sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import StageArea
from .common import chunks, column, mix64, parts, prefix_hash, ranges, raw, slice_hash, small_batches, tidy

#: bytes of the k-gram that a suffix is partitioned by
TOKEN = 40
#: windows of one piece at most
PIECE = 512
#: bytes of text per numpy step
STEP = 1 << 20
#: a token with more different pieces is split by window fingerprints
HOT_PIECES = 20_000


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _pieces(window: int):
    """Per document the pieces (token, digest, lo, n): neighbouring suffixes lo .. lo + n - 1 with the same token.

    A suffix's token is the least hash among the k-grams of its first ``window`` bytes. Suffixes with equal first
    ``window`` bytes have equal tokens.
    """
    token = min(TOKEN, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(3), STEP):
                if len(part.data) < window:
                    continue
                size = np.diff(part.starts)
                count = np.maximum(0, size - window + 1)
                p = ranges(part.starts[:-1], count)
                if not len(p):
                    continue
                prefix = prefix_hash(part.data)
                at = np.arange(len(part.data) - token + 1)
                grams, width = slice_hash(prefix, at, at + token), window - token + 1
                least = sliding_min(grams, width)
                known = np.zeros(len(least) + 2 * width - 2, np.uint64)
                known[p + width - 1] = least[p]
                tops = np.flatnonzero(grams == ~sliding_min(~known, width))  # the k-grams that are some suffix's least
                least = least[p]
                row = np.repeat(np.arange(len(count)), count)
                new = np.ones(len(p), bool)
                new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                start = np.flatnonzero(new)
                inside = np.arange(len(p)) - np.repeat(start, np.diff(np.append(start, len(p))))
                start = np.flatnonzero(inside % PIECE == 0)
                n = np.diff(np.append(start, len(p)))
                lo = p[start]
                digest = slice_hash(prefix, lo, lo + n + window - 1)
                # a piece can repeat its own suffixes only if the least k-gram stands in it twice
                values, rank = np.unique(grams[tops], return_inverse=True)
                spots = np.sort(rank * len(part.data) + tops)
                rank = np.searchsorted(values, least[start]) * len(part.data)
                twice = np.searchsorted(spots, rank + lo + n - 1 + width) - np.searchsorted(spots, rank + lo) > 1
                pick = pa.array(part.lo + row[start])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mix64(least[start]).view(np.int64)),
                        pa.array(digest.view(np.int64)),
                        batch.column(0).take(pick),
                        batch.column(1).take(pick),
                        batch.column(2).take(pick),
                        pa.array((lo - part.starts[row[start]]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(twice),
                    ],
                    names=["token", "digest", "doc_id", "mark", "check", "lo", "n", "twice"],
                )

    return run


def _cut(window: int):
    """Bytes of the pieces asked for: rows of (text, wanted) to (token, digest, copies, many, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[list] = [[], [], [], [], []]
                part = batch.slice(at, 256)
                for text, wanted in zip(part.column(0), part.column(1).to_pylist()):
                    text = memoryview(text.as_buffer())
                    for w in wanted:
                        row = (w["token"], w["digest"], w["copies"], w["many"], bytes(text[w["lo"] : w["lo"] + w["n"] + window - 1]))
                        for values, v in zip(out, row):
                            values.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["token", "digest", "copies", "many", "piece"])

    return run


def equal_suffixes(data: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes share their first ``depth`` bytes with another one of their group.

    Multikey quicksort on characters of eight bytes: the suffixes of a class are partitioned by their next character,
    classes of one suffix are done, and a class whose characters are all equal moves on unsorted. ``group`` ascends.
    """
    wide = np.concatenate((data, np.zeros(8, np.uint8)))
    view = np.lib.stride_tricks.as_strided(wide, (len(wide) - 7, 8), (1, 1))
    alive = np.arange(len(start))
    kind = group
    steps = [*range(0, depth - 7, 8), *([max(0, depth - 8)] if depth % 8 else [])]
    for step in steps:
        if not len(alive):
            break
        key = view[start[alive] + step].copy().view(">u8")[:, 0].astype(np.uint64)
        if depth < 8:
            key >>= np.uint64(64 - 8 * depth)
        head = np.ones(len(alive), bool)
        head[1:] = kind[1:] != kind[:-1]
        apart = np.zeros(len(alive), bool)
        apart[1:] = ~head[1:] & (key[1:] != key[:-1])
        if apart.any():
            first = np.flatnonzero(head)
            mixed = np.repeat(np.add.reduceat(apart, first) > 0, np.diff(np.append(first, len(alive))))
            at = np.flatnonzero(mixed)
            turn = at[np.lexsort((key[at], kind[at]))]
            alive[at], key[at] = alive[turn], key[turn]  # a class keeps its places
            head[1:] |= key[1:] != key[:-1]
        kind = np.cumsum(head)
        size = np.bincount(kind)[kind]
        alive, kind = alive[size > 1], kind[size > 1]
    out = np.zeros(len(start), bool)
    out[alive] = True
    return out


def _starts(offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffix starts of concatenated pieces and the piece of each."""
    n = np.diff(offsets) - window + 1
    return ranges(offsets[:-1], n), np.repeat(np.arange(len(n)), n)


def _repeated(flags: np.ndarray, piece: np.ndarray, inside: np.ndarray, n: int) -> list[list[dict[str, int]]]:
    """Runs of flagged suffixes of each piece as first and last offset."""
    at = np.flatnonzero(flags)
    out: list[list[dict[str, int]]] = [[] for _ in range(n)]
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(piece[at]) != 0)
        first = at[new]
        last = at[np.append(new[1:], True)]
        for k, a, b in zip(piece[first].tolist(), inside[first].tolist(), inside[last].tolist()):
            out[k].append({"a": a, "b": b})
    return out


def _sort_bucket(window: int):
    """Rows (token, digest, copies, piece) in the order of the token to (token, digest, runs of repeated suffixes)."""
    runs = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def done(tokens: np.ndarray, digests: np.ndarray, copies: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        start, piece = _starts(offsets, window)
        inside = start - offsets[piece]
        # rolling hashes drop the suffixes that are alone; the bytes decide on the others
        group = tokens[piece]
        hashed = slice_hash(prefix_hash(data), start, start + window)
        order = np.lexsort((hashed, group))
        same = (group[order[1:]] == group[order[:-1]]) & (hashed[order[1:]] == hashed[order[:-1]])
        twin = np.zeros(len(start), bool)
        twin[order[1:]] |= same
        twin[order[:-1]] |= same
        order = order[twin[order]]
        flags = np.zeros(len(start), bool)
        flags[order] = equal_suffixes(data, start[order], np.cumsum(np.concatenate(([0], np.diff(group[order]) != 0))) if len(order) else order, window)
        flags |= copies[piece] > 1
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens), pa.array(digests), pa.array(_repeated(flags, piece, inside, len(texts)), runs)], names=["token", "digest", "runs"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if size > STEP and row[0] != held[-1][0]:  # a token is never cut
                    yield done(*[np.array(x, np.int64) for x in list(zip(*held))[:3]], [r[3] for r in held])
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield done(*[np.array(x, np.int64) for x in list(zip(*held))[:3]], [r[3] for r in held])

    return run


def _fingerprints(window: int):
    """Rows (token, digest, copies, piece) to a row per suffix (token, digest, copies, at, x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(3), STEP // 4):
                start, piece = _starts(part.starts, window)
                x = slice_hash(prefix_hash(part.data), start, start + window)
                y = slice_hash(prefix_hash(part.data ^ np.uint8(0x5A)), start, start + window)
                pick = pa.array(part.lo + piece)
                inside = (start - part.starts[piece]).astype(np.int32)
                columns = [batch.column(k).take(pick) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(inside), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["token", "digest", "copies", "at", "x", "y"]
                )

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, spans) to what stays of each text."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(part.column(1), part.column(2).to_pylist()):
                text = text.as_buffer().to_pybytes()
                merged: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                edges = [0, *[e for m in merged for e in m], len(text)]
                kept = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])
                for values, v in zip(out, (len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept)):
                    values.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v, t) for v, t in zip(out, kinds)]], names=names)


def _same_row(found: DataFrame) -> tuple[DataFrame, Column]:
    """``found`` with its key renamed, and the condition that it is of the same id and text."""
    found = found.withColumnsRenamed({"doc_id": "id", "mark": "m", "check": "c"})
    return found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")) & (F.col("check") == F.col("c"))


def remove_repeats(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text", hot_pieces: int = HOT_PIECES) -> DataFrame:
    """Every row's text without the bytes covered by a ``window``-byte string that starts anywhere else too.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (the remaining bytes).
    Strings are judged on the input and never cross texts; overlapping places in one text count.

    A suffix needs to be sorted among those with the same token only, and suffixes that follow each other mostly
    share it, so they travel together as pieces of text. Counts per token drop the pieces that are alone and can't
    repeat themselves; a token with several pieces that are all equal needs no sorting. One piece of each kind of the other tokens goes through the range
    partition by token (splitters sampled from the pieces) to a bucket, which sorts its suffixes and compares
    neighbours. Equal suffixes never stand on both sides of a bucket's boundary, since all suffixes of a token go to
    one bucket. A token with more than ``hot_pieces`` kinds of pieces is dealt by 128-bit fingerprints of its suffixes
    instead.
    Null text counts as empty, texts shorter than ``window`` stay whole, null and repeated ids are rows like others
    (rows with equal id and text get equal answers), an empty table gives an empty result, other columns are ignored.
    """
    if window < 8:
        raise ValueError("strings of less than 8 bytes are not supported")
    area = StageArea(docs.sparkSession, "suffixes")
    small_batches(docs.sparkSession)
    texts = docs.select(column(id_col).alias("doc_id"), raw(text_col).alias("body"))
    # rows are told apart by the id and 128 bits of the text's hashes, as ids may be null or repeated
    texts = texts.withColumns({"mark": F.xxhash64("body"), "check": F.xxhash64(F.lit(1), "body")})
    kind = texts.schema["doc_id"].dataType.simpleString()
    pieces = texts.filter(F.length("body") >= window).select("doc_id", "mark", "check", "body")
    pieces = pieces.mapInArrow(tidy(_pieces(window)), f"token long, digest long, doc_id {kind}, mark long, check long, lo int, n int, twice boolean")
    shared = pieces.groupBy("token").agg(F.count("*").alias("places"), F.min("digest").alias("low"), F.max("digest").alias("high"), F.max("twice").alias("twice"))
    shared = shared.filter("places > 1 OR twice").select("token", (F.expr("low <> high OR places = 1")).alias("mixed"))
    held = area.save(pieces.drop("twice").join(shared, "token"), "pieces")

    kinds = held.filter("mixed").groupBy("token", "digest")
    kinds = kinds.agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("doc_id", "mark", "check", "lo", "n")])
    hot = kinds.groupBy("token").count().filter(F.col("count") > hot_pieces).select("token", F.lit(True).alias("many"))
    kinds = kinds.join(hot, "token", "left").na.fill(False, ["many"])
    wanted = kinds.groupBy("doc_id", "mark", "check").agg(F.collect_list(F.struct("token", "digest", "copies", "many", "lo", "n")).alias("wanted"))
    fetched = texts.join(*_same_row(wanted)).select("body", "wanted")
    cut = fetched.mapInArrow(tidy(_cut(window)), "token long, digest long, copies long, many boolean, piece binary")
    cut = area.save(cut.dropDuplicates(["token", "digest"]), "kinds")  # a repeated row brings its pieces twice

    runs = "token long, digest long, runs array<struct<a: int, b: int>>"
    cold = cut.filter("NOT many").select("token", "digest", "copies", "piece").repartitionByRange(parts(docs.sparkSession), "token")
    found = cold.sortWithinPartitions("token").mapInArrow(tidy(_sort_bucket(window)), runs)
    prints = cut.filter("many").select("token", "digest", "copies", "piece")
    prints = prints.mapInArrow(tidy(_fingerprints(window)), "token long, digest long, copies long, at int, x long, y long")
    twice = prints.groupBy("token", "x", "y").agg(F.sum("copies").alias("times")).filter("times > 1").select("token", "x", "y")
    hot = prints.join(twice, ["token", "x", "y"]).groupBy("token", "digest").agg(F.collect_list(F.struct(F.col("at").alias("a"), F.col("at").alias("b"))).alias("runs"))
    found = area.save(found.unionByName(hot).filter(F.size("runs") > 0), "runs")

    span = lambda a, b: F.struct((F.col("lo") + a).alias("a"), (F.col("lo") + b + window).alias("b"))
    whole = held.filter("NOT mixed").select("doc_id", "mark", "check", F.array(span(F.lit(0), F.col("n") - 1)).alias("spans"))
    some = held.filter("mixed").join(found, ["token", "digest"]).select("doc_id", "mark", "check", F.transform("runs", lambda r: span(r["a"], r["b"])).alias("spans"))
    # a set: rows that repeat id and text bring the same spans
    spans = whole.unionByName(some).groupBy("doc_id", "mark", "check").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    rows = texts.join(*_same_row(spans), "left").select("doc_id", "body", "spans")
    return rows.mapInArrow(tidy(_keep), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
