"""Token ids as files: canonical length-limited Huffman codes in independent blocks, and their table-driven decoding."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import StageArea
from .common import parts, plain

#: bits of the longest code; a decoding table has 2 ** MAX_BITS entries
MAX_BITS = 18
#: ids per block, about; a document is never cut
BLOCK_IDS = 1 << 16
#: ids between two bit offsets
CHECKPOINT = 64
#: pieces of text whose ids a worker remembers, about
REMEMBERED = 1_200_000


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with no code longer than ``max_bits`` (package-merge); 0 for unused ids."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids don't fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    # each round pairs the cheapest packages and merges them with the coins; only which packages are coins is kept
    is_coin = []
    level = coins
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate((coins, pairs))
        turn = np.argsort(merged, kind="stable")
        is_coin.append(turn < n)
        level = merged[turn]
    take = 2 * n - 2
    depth = np.zeros(n + 1, np.int64)
    for flags in reversed(is_coin):
        own = int(flags[:take].sum())
        depth[0] += 1
        depth[own] -= 1
        take = 2 * (take - own)
    depth[0] += 1
    depth[take] -= 1
    lengths[order] = np.cumsum(depth)[:n]
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of length and id, each one more than the last, shifted where the length grows."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        width = lengths[order].astype(np.int64)
        top = int(width[-1])
        room = np.left_shift(np.int64(1), top - width)
        codes[order] = (np.concatenate(([0], np.cumsum(room)[:-1])) >> (top - width)).astype(np.uint32)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """The ids' bits, and the number of bits of every CHECKPOINT ids as 16-bit integers."""
    if not len(ids):
        return b"", b""
    width = lengths.astype(np.int64)[ids]
    if not width.all():
        raise ValueError("an id has no code")
    end = np.cumsum(width)
    begin = end - width
    words = np.zeros(int(end[-1]) // 32 + 2, np.uint64)
    # a code lies in one or two 32-bit words; what falls into one word never overlaps, so sums are unions
    left = codes.astype(np.uint64) << (np.uint64(64) - np.maximum(lengths, 1).astype(np.uint64))  # codes at the top
    shifted = left[ids] >> (begin & 31).view(np.uint64)
    word = begin >> 5
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
    words[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    marks = np.add.reduceat(width, np.arange(0, len(ids), CHECKPOINT)).astype("<u2")
    return words.astype(">u4").tobytes()[: int(end[-1] + 7) // 8], marks.tobytes()


class Decoder:
    """Table-driven: the next ``max_bits`` bits give an id and its length. All checkpoints of a batch go in step."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.bits = int(lengths.max(initial=1)) if len(used) else 1
        order = used[np.lexsort((used, lengths[used]))]
        room = np.left_shift(1, self.bits - lengths[order].astype(np.int64))
        self.ids = np.zeros(1 << self.bits, np.uint32)
        self.widths = np.zeros(1 << self.bits, np.uint8)
        self.ids[: int(room.sum())] = np.repeat(order, room)
        self.widths[: int(room.sum())] = np.repeat(lengths[order], room)

    def unpack(self, blocks: list[tuple[bytes, bytes, int]]) -> list[np.ndarray]:
        """Ids of blocks of (bits, marks, number of ids)."""
        at, base, sizes, padded = [], 0, [], []
        for bits, marks, n in blocks:
            steps = np.frombuffer(marks, "<u2").astype(np.int64)
            at.append(base * 8 + np.cumsum(steps) - steps)
            full = np.full(len(steps), CHECKPOINT, np.int64)
            if n:
                full[-1] = n - CHECKPOINT * (len(steps) - 1)
            sizes.append(full)
            padded.append(bits + bytes(-len(bits) % 4))
            base += len(padded[-1])
        words = np.frombuffer(b"".join([*padded, bytes(8)]), ">u4").astype(np.uint64)
        windows = (words[:-1] << np.uint64(32)) | words[1:]  # 64 bits from every 32-bit word on
        lane, size = np.concatenate(at), np.concatenate(sizes)
        out = np.zeros((len(lane), CHECKPOINT), np.uint32)
        mask = np.uint64((1 << self.bits) - 1)
        turn = np.argsort(-size, kind="stable")  # short lanes last, so that those still open are a prefix
        lane, left = lane[turn], size[turn]
        got = np.zeros_like(out)
        for k in range(CHECKPOINT):
            n = int(np.searchsorted(-left, -k, side="left"))
            if not n:
                break
            pos = lane[:n]
            code = ((windows[pos >> 5] >> (np.int64(64 - self.bits) - (pos & 31)).view(np.uint64)) & mask).view(np.int64)
            got[:n, k] = self.ids[code]
            lane[:n] += self.widths[code]
        out[turn] = got
        flat = out[np.arange(CHECKPOINT) < size[:, None]]
        return np.split(flat, np.cumsum([n for _, _, n in blocks])[:-1])


#: all white space but the space and the line end, and the mark that texts are cut at
RARE_SPACE = re.compile("[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


# The byte-level vocabulary writes printable bytes as themselves and the others as characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
#: up to here all tables agree on what a letter is
LATIN_END = "\u0250"


class Encoder:
    """Ids of texts from a tokenizers file.

    Its pre-tokenizer never joins what stands before a single space or line end with what follows, nor a letter or
    digit with one full stop or comma at a piece's end. So a text without longer white space is cut there, and equal
    pieces are encoded once. Other texts, and those with an added token's content, are encoded whole.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = {"<u2": "H", "<u4": "I"}[kind]
        self.known = Memory(self)
        self.cuts = ["  ", " \n", "\n ", "\n\n", *[t.content for t in self.tokenizer.get_added_tokens_decoder().values()]]
        self.stops = dict(zip(".,", self._ids([".", ","])))
        self.breaks = self._ids(["\n"])[0]
        sample = ["word", " word", "Wörter", " élève"]
        self.model = self.tokenizer.model if self._letters(sample, self.tokenizer.model) == self._ids(sample) else None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, got.ids).tobytes() for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str], model) -> list[bytes]:
        """Ids of words that the pre-tokenizer leaves whole, from the model alone."""
        return [array(self.code, [t.id for t in model.tokenize(x.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes() for x in words]

    def _pieces(self, text: str) -> list[str] | None:
        if any(x in text for x in self.cuts) or text[:1].isspace() or text[-1:].isspace():
            return None  # white space of more than one character, or at an end
        if RARE_SPACE.search(text):
            words = text.split()
            if "\0" in text or len(text) - len("".join(words)) != max(0, len(words) - 1):
                return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def piece(self, x: str) -> bytes:
        """Ids of a piece. Full stops, commas and line ends at a word are tokens of their own."""
        head = tail = b""
        y = x
        if y[:1] == "\n" and len(y) > 1:
            head, y = self.breaks, y[1:]
        if y[-1:] in self.stops and y[-2:-1].isalnum():
            tail, y = self.stops[y[-1]], y[:-1]
        if y is not x:
            return head + self.known[y] + tail
        word = y[1:] if y[:1] == " " else y
        if self.model is not None and word.isalpha() and max(word) < LATIN_END:
            return self._letters([y], self.model)[0]
        return self._ids([y])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as integers of the encoder's kind."""
        get = self.known.__getitem__
        cut = [self._pieces(text) for text in texts]
        whole = iter(self._ids([t for t, p in zip(texts, cut) if p is None]))
        return [next(whole) if p is None else b"".join(map(get, p)) for p in cut]


class Memory(dict):
    """Ids by piece; a new piece is encoded when it is first asked for, and kept while there is room. What comes
    first is mostly what comes often."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoder.piece(piece)
        if len(self) < REMEMBERED:
            self[piece] = ids
        return ids


#: of this Python worker; later tasks know the pieces of earlier ones
_encoders: dict[tuple[str, str], Encoder] = {}


def _tokenize(path: str, end_id: int, kind: str, vocabulary: int):
    """Rows (doc_id, text) to (doc_id, ids) and, at a task's end, one row with its id counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoders.get((path, kind)) or _encoders.setdefault((path, kind), Encoder(path, kind))
        tail = np.array([end_id], kind).tobytes()
        counts = np.zeros(vocabulary, np.int64)
        names = ["doc_id", "ids", "counts"]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            texts = [x.decode() for x in batch.column(1).to_pylist()]
            ids = []
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held < 1 << 20):
                    held += len(texts[to])
                    to += 1
                ids += [x + tail for x in encoder.encode(texts[at:to])]
                part = np.bincount(np.frombuffer(b"".join(ids[at:to]), kind))
                counts[: len(part)] += part
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
        if id_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=names)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0).to_pylist():
            part = np.frombuffer(zlib.decompress(x), np.int64)
            total = part if total is None else total + part
    if total is not None:
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


BLOCKS = "part int, block int, first_token long, n_tokens long, bits binary, marks binary, sizes array<long>"


def _blocks(kind: str, lengths: np.ndarray, codes: np.ndarray, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block = first = held = 0
        keys: list = []
        pieces: list[np.ndarray] = []
        names = ["part", "block", "first_token", "n_tokens", "bits", "marks", "sizes", "doc_ids"]

        def flush() -> pa.RecordBatch:
            nonlocal block, first, held
            ids = np.concatenate(pieces)
            bits, marks = pack(ids, lengths, codes)
            sizes = [len(x) for x in pieces]
            row = [
                pa.array([part], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([first], pa.int64()),
                pa.array([len(ids)], pa.int64()),
                pa.array([bits], pa.binary()),
                pa.array([marks], pa.binary()),
                pa.array([sizes], pa.list_(pa.int64())),
                pa.array([keys], pa.list_(id_type)),
            ]
            block, first, held = block + 1, first + len(ids), 0
            keys.clear()
            pieces.clear()
            return pa.RecordBatch.from_arrays(row, names=names)

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(ids.as_buffer(), kind)
                if held and held + len(x) > BLOCK_IDS:
                    yield flush()
                keys.append(key)
                pieces.append(x)
                held += len(x)
        if pieces:
            yield flush()

    return run


def _read(lengths: np.ndarray, id_type: pa.DataType, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                rows = batch.slice(at, 16).to_pydict()
                blocks = decoder.unpack(list(zip(rows["bits"], rows["marks"], rows["n_tokens"])))
                out: dict[str, list] = {k: [] for k in ("part", "doc_id", "inside", "n_tokens", "ids_crc32", "ids")}
                for part, first, sizes, keys, ids in zip(rows["part"], rows["first_token"], rows["sizes"], rows["doc_ids"], blocks):
                    for key, x in zip(keys, np.split(ids, np.cumsum(sizes)[:-1])):
                        data = x.astype("<u4").tobytes()
                        for name, v in zip(out, (part, key, first, len(x), zlib.crc32(data), data if with_ids else None)):
                            out[name].append(v)
                        first += len(x)
                types = (pa.int32(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> None:
    """Tokenize and write ``folder``/codebook (id, length) and ``folder``/blocks, in ascending order of the id.

    Each text's ids are followed by ``end_id``; null text is empty. Blocks are numbered within a range of ids
    (``part``), hold whole documents and decode on their own: ``marks`` are the bits of every 64 ids. Null ids come
    first; rows that repeat an id stand side by side. An empty table writes no block. Other columns are ignored.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    area = StageArea(spark, "tokens")
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    source = plain(docs, id_col, text_col)
    id_field = source.schema["doc_id"]
    schema = StructType([id_field, *StructType.fromDDL("ids binary, counts binary").fields])
    staged = area.path("ids")
    source.mapInArrow(_tokenize(tokenizer, end_id, kind, vocabulary), schema).write.option("compression", "zstd").parquet(staged)
    ids = spark.read.schema(schema).parquet(staged)
    # at most a row per id of the vocabulary
    counts = np.zeros(vocabulary, np.int64)
    shares = ids.filter("counts IS NOT NULL").select("counts").mapInArrow(_count, "id long, n long")
    for r in shares.groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.id] = r.n
    lengths = code_lengths(counts, max_bits)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int").coalesce(1).write.parquet(f"{folder}/codebook")
    arrow_id = pa.int64() if isinstance(id_field.dataType, LongType) else pa.string()
    key = ids.filter("ids IS NOT NULL").select("doc_id" if arrow_id == pa.int64() else F.col("doc_id").cast("string").alias("doc_id"), "ids")
    block_schema = StructType([*StructType.fromDDL(BLOCKS).fields, *StructType.fromDDL(f"doc_ids array<{'long' if arrow_id == pa.int64() else 'string'}>").fields])
    (
        key.repartitionByRange(parts(spark), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("ids"))
        .mapInArrow(_blocks(kind, lengths, canonical(lengths), arrow_id), block_schema)
        .write.option("compression", "uncompressed")
        .parquet(f"{folder}/blocks")
    )


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents of a written folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and the ids
    themselves as little-endian 32-bit integers (null without ``with_ids``). Only the code book is held by every task."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    book = spark.read.parquet(f"{folder}/codebook").toPandas()  # a row per id of the vocabulary at most
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"].to_numpy(np.int64)] = book["length"].to_numpy(np.uint8)
    key = blocks.schema["doc_ids"].dataType.elementType
    arrow_id = pa.int64() if isinstance(key, LongType) else pa.string()
    schema = StructType([StructField("part", StructType.fromDDL("x int").fields[0].dataType), StructField("doc_id", key), *StructType.fromDDL("inside long, n_tokens long, ids_crc32 long, ids binary").fields])
    wanted = blocks.select("part", "first_token", "n_tokens", "bits", "marks", "sizes", "doc_ids")
    rows = wanted.mapInArrow(_read(lengths, arrow_id, with_ids), schema)
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per written range
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return rows.join(before, "part").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "ids")
