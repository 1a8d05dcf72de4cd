"""Byte-level BPE: texts to ids by batched numpy merge rounds, and ids back to texts.

The distinct pieces of many texts stand in one flat array of symbols. A round finds the lowest-rank pair of every piece
(ranks come from a binary search over the sorted pair keys) and merges it everywhere in the piece.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, chunks, ranges

# Fixed value: how byte-level tokenizers cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Printable bytes are written as themselves, the others as characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN_AS = _SHOWN + [256 + i for i in range(256 - len(_SHOWN))]
CHAR_BYTE = dict(zip(map(chr, _SHOWN_AS), _SHOWN + sorted(set(range(256)) - set(_SHOWN))))

#: bytes of text whose pieces are merged together
STEP_BYTES = 4 << 20
#: symbols from which a piece is merged by a queue of its own: rounds over it would take its length times its pairs
LONG = 4096
#: rank of a pair that no rule merges
NONE = np.int32(np.iinfo(np.int32).max)


class Vocabulary:
    """Merge rules, token bytes and added tokens of a tokenizers file (byte-level BPE)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain_model = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain_cut = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        added = spec.get("added_tokens") or []
        if not plain_model or not plain_cut or spec.get("normalizer") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        ids = model["vocab"]
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max([*ids.values(), *(t["id"] for t in added)]) + 1
        pairs = np.array([(ids[a], ids[b]) for a, b in rules], np.int64).reshape(-1, 2)
        self.merged = np.array([ids[a + b] for a, b in rules], np.int32)
        made = np.full(self.size, -1, np.int64)
        made[self.merged[::-1]] = np.arange(len(rules))[::-1]
        if (made[pairs].max(axis=1, initial=-1) >= np.arange(len(rules))).any():
            raise ValueError("a merge rule stands before the rules of its parts")  # merging all of a rank at once needs this order
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.byte_ids = np.zeros(256, np.int32)
        texts = [b""] * self.size
        for token, i in ids.items():
            texts[i] = bytes(CHAR_BYTE[c] for c in token)
            if len(token) == 1:
                self.byte_ids[CHAR_BYTE[token]] = i
        for t in added:
            known = all(c in CHAR_BYTE for c in t["content"])
            texts[t["id"]] = bytes(CHAR_BYTE[c] for c in t["content"]) if known else t["content"].encode()
        self.bytes = _Table(texts)
        self.decimals = _Table([b"%d," % i for i in range(self.size)])
        self.added = {t["content"]: t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.pieces = regex.compile(PIECES)
        self._cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self._kinds: dict[int, str | None] = dict.fromkeys(range(0x250))  # up to here all character tables agree

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, NONE where no rule holds."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE) if len(self.keys) else np.full(len(key), NONE)

    def cut(self, text: str) -> list[str]:
        """The text's pieces. Characters that the file's library takes for another kind than ``regex`` does (its tables
        are of another Unicode version) are cut like a stand-in of the library's kind."""
        if text.isascii():
            return self.pieces.findall(text)
        odd = {}
        for c in set(text):
            code = ord(c)
            if code not in self._kinds:
                self._kinds[code] = self._stand_in(c)
            if self._kinds[code]:
                odd[code] = self._kinds[code]
        if not odd:
            return self.pieces.findall(text)
        return [text[m.start() : m.end()] for m in self.pieces.finditer(text.translate(odd))]

    def _stand_in(self, c: str) -> str | None:
        """A character of the library's kind where ``regex`` sees another kind."""
        theirs = next((x for x in "a1!" if len(self._cut(x + c)) == 1), " ")
        ours = next((x for x in "a1!" if len(self.pieces.findall(x + c)) == 1), " ")
        return None if theirs == ours else theirs

    def parts(self, text: str) -> list[str | int]:
        """Pieces, and the ids of added tokens between them."""
        if self.split is None or not any(x in text for x in self.added):
            return self.cut(text)
        out: list[str | int] = []
        for part in self.split.split(text):
            out += [self.added[part]] if part in self.added else self.cut(part)
        return out


class _Table:
    """Byte strings side by side, to be taken by number."""

    def __init__(self, values: list[bytes]):
        self.data = np.frombuffer(b"".join(values), np.uint8)
        self.size = np.array([len(x) for x in values], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def take(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of ``ids`` in a row, and where each ends."""
        size = self.size[ids]
        return self.data[ranges(self.start[ids], size)], np.cumsum(size)


def merge(data: np.ndarray, lengths: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces of bytes (each of one byte at least), in order, and how many each piece has."""
    n = len(lengths)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # pieces, their sizes, their ids in a row
    sym = v.byte_ids[data]
    word, size = np.arange(n), lengths.astype(np.int64)
    long = np.flatnonzero(size >= LONG)
    if len(long):
        start = np.cumsum(size) - size
        for w in long:
            ids = merge_long(sym[start[w] : start[w] + size[w]], v)
            done.append((np.array([w]), np.array([len(ids)]), ids))
        short = size < LONG
        sym, word, size = sym[np.repeat(short, size)], word[short], size[short]
    last = np.zeros(len(sym), bool)
    last[np.cumsum(size) - 1] = True
    rank = np.full(len(sym), NONE)
    inner = np.flatnonzero(~last)
    rank[inner] = v.rank(sym[inner], sym[inner + 1])
    while len(word):
        best = np.minimum.reduceat(rank, np.cumsum(size) - size)
        over = best == NONE
        if over.any():
            out = np.repeat(over, size)
            done.append((word[over], size[over], sym[out]))
            sym, rank, last = sym[~out], rank[~out], last[~out]
            word, size, best = word[~over], size[~over], best[~over]
            if not len(word):
                break
        owner = np.repeat(np.arange(len(word)), size)
        at = np.flatnonzero(rank == best[owner])
        close = np.concatenate(([False], at[1:] == at[:-1] + 1))
        if close.any():  # in a run of one symbol every second pair overlaps the one before
            run = np.flatnonzero(~close)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        sym[at] = v.merged[rank[at]]
        last[at] = last[at + 1]
        live = np.ones(len(sym), bool)
        live[at + 1] = False
        size -= np.bincount(owner[at], minlength=len(word))
        sym, rank, last = sym[live], rank[live], last[live]
        here = at - np.arange(len(at))
        near = np.concatenate((here, here[here > 0] - 1))  # only pairs beside a merged symbol are new
        rank[near] = NONE
        near = near[~last[near]]
        rank[near] = v.rank(sym[near], sym[near + 1])
    counts = np.zeros(n, np.int64)
    for w, s, _ in done:
        counts[w] = s
    start = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), np.int32)
    for w, s, x in done:
        ids[ranges(start[w], s)] = x
    return ids, counts


def merge_long(sym: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The same for one very long piece, pair by pair from a queue of (rank, place)."""
    n = len(sym)
    at = np.flatnonzero((first := v.rank(sym[:-1], sym[1:])) != NONE)
    queue = list(zip(first[at].tolist(), at.tolist()))
    heapq.heapify(queue)
    s = sym.tolist()
    rank = first.tolist() + [int(NONE)]
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    rules = dict(zip(v.keys.tolist(), v.ranks.tolist()))
    while queue:
        r, i = heapq.heappop(queue)
        if rank[i] != r:
            continue  # one of the two was merged meanwhile
        j = right[i]
        s[i], rank[j] = int(v.merged[r]), -1
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        for k in (i, left[i]):
            if k >= 0:
                rank[k] = rules.get(s[k] * v.size + s[right[k]], int(NONE)) if right[k] < n else int(NONE)
                if rank[k] != NONE:
                    heapq.heappush(queue, (rank[k], k))
    return np.array([s[i] for i in range(n) if rank[i] >= 0], np.int32)


def encode_texts(texts: Iterable[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and how many each text has. Equal pieces are merged once."""
    number: dict[str, int] = {}
    get = number.setdefault
    codes: list[int] = []
    ends = []
    for text in texts:
        # an added token is coded as -1 - id
        codes += [get(x, len(number)) if x.__class__ is str else -1 - x for x in v.parts(text)]
        ends.append(len(codes))
    code = np.array(codes, np.int64)
    encoded = [x.encode() for x in number]
    ids, counts = merge(np.frombuffer(b"".join(encoded), np.uint8), np.array([len(x) for x in encoded], np.int64), v)
    special = code < 0
    if special.any():
        extra, code = np.unique(-1 - code[special]), code.copy()
        code[special] = len(counts) + np.searchsorted(extra, -1 - code[special])
        ids, counts = np.concatenate((ids, extra.astype(np.int32))), np.concatenate((counts, np.ones(len(extra), np.int64)))
    begin = np.cumsum(counts) - counts
    size = counts[code]
    total = np.concatenate(([0], np.cumsum(size)))
    per_text = np.diff(total[np.concatenate(([0], ends)).astype(np.int64)])
    return ids[ranges(begin[code], size)], per_text


def decode_texts(ids: np.ndarray, counts: np.ndarray, v: Vocabulary) -> list[bytes]:
    """UTF-8 bytes of each text; what is no valid UTF-8 becomes U+FFFD, ids outside the vocabulary give nothing."""
    known = (ids >= 0) & (ids < v.size)
    if not known.all():
        owner = np.repeat(np.arange(len(counts)), counts)
        ids, counts = ids[known], np.bincount(owner[known], minlength=len(counts))
    data, end = v.bytes.take(ids)
    cut = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(counts)))]
    return [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(cut[:-1], cut[1:])]


def _id_digests(ids: np.ndarray, counts: np.ndarray, v: Vocabulary) -> list[str]:
    """SHA-256 of the decimal ids of each text, joined by commas."""
    data, end = v.decimals.take(ids)
    cut = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(counts)))]
    return [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(cut[:-1], cut[1:])]


#: of this Python worker; reading a vocabulary takes a good second
_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    return _loaded.get(path) or _loaded.setdefault(path, Vocabulary(path))


def _steps(path: str, work: Callable[[np.ndarray, np.ndarray, Vocabulary], list[list]], types: list[pa.DataType]):
    """From texts to ids, step by step, and from these to new columns by ``work``."""

    def start():
        v = vocabulary(path)

        def run(column: pa.Array) -> list[pa.Array]:
            out: list[list] = [[] for _ in types]
            for part in chunks(column, STEP_BYTES):
                ids, counts = encode_texts((part.text(i).decode("utf-8", "replace") for i in range(len(part))), v)
                for have, more in zip(out, work(ids, counts, v)):
                    have += more
            return [pa.array(values, t) for values, t in zip(out, types)]

        return run

    return start


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and ``ids``, the ids of the text in a tokenizers file of byte-level BPE.

    Added tokens in a text give their own id. Null and empty texts give an empty list; a text of any length is one
    list. Equal rows give equal rows, an empty table an empty one. A column ``ids`` of the input is replaced.
    """
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c != "ids")

    def work(ids: np.ndarray, counts: np.ndarray, v: Vocabulary) -> list[list]:
        return [np.split(ids, np.cumsum(counts)[:-1])]

    return annotate(docs, _steps(tokenizer, work, [pa.list_(pa.int32())]), "ids array<int>", text_col, keep)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """All columns but ``into``, and ``into``: the text of the ids.

    Null stays null; an id that is null or outside the vocabulary adds nothing; invalid UTF-8 becomes U+FFFD.
    """

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        v = vocabulary(tokenizer)
        lists = [np.array([-1 if i is None or i != i else i for i in x], np.int64) if x is not None else None for x in values]
        counts = np.array([0 if x is None else len(x) for x in lists], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *(x for x in lists if x is not None)])
        return pd.Series([None if x is None else t.decode() for x, t in zip(lists, decode_texts(flat, counts, v))], dtype=object)

    others = [F.col(f"`{c}`") for c in encoded.columns if c != into]
    return encoded.select(*others, text(F.col(f"`{ids_col}`")).alias(into))


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 (the text decoded
    from these ids, in UTF-8). Null counts as empty; nothing is shuffled, and a step holds about ``STEP_BYTES`` of text
    or one longer text."""

    def work(ids: np.ndarray, counts: np.ndarray, v: Vocabulary) -> list[list]:
        decoded = [hashlib.sha256(x).hexdigest() for x in decode_texts(ids, counts, v)]
        return [counts.tolist(), _id_digests(ids, counts, v), decoded]

    start = _steps(tokenizer, work, [pa.int64(), pa.string(), pa.string()])
    return annotate(docs, start, "n_tokens long, ids_sha256 string, decoded_sha256 string", text_col, (id_col,))
