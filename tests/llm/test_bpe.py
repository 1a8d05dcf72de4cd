"""Byte-level BPE by merge rounds against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import pytest

from daymart.llm import bpe, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def odd_texts():
    r = random.Random(3)
    alphabet = "aab  \n\t'stredmvl019.,!?éßñ漢字́\x00\x1c\x1d\x85\xa0 ՘֋\U00010940\U0001f600​½Ⅷ"
    out = ["", "a", " ", "a  ", "  a", "\n\n", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "aaaaaaaaa", "don't they'll"]
    out += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    out += ["".join(chr(r.choice([r.randint(0, 0x2FF), r.randint(0, 0xD7FF), r.randint(0xE000, 0x10FFFF)])) for _ in range(60)) for _ in range(200)]
    out += ["".join(r.choice("abcdefghij") for _ in range(n)) for n in (bpe.LONG - 1, bpe.LONG, 20000)]
    return [*out, "a" * 9000, " " * 9000, "ab" * 9000, "word and 1234. " * 20000]


def test_ids_and_texts_equal_the_library(library, vocabulary):
    texts = odd_texts()
    ids, counts = bpe.encode_texts(texts, vocabulary)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.decode() for x in bpe.decode_texts(ids, counts, vocabulary)] == texts


def test_decoding_of_any_ids(library, vocabulary):
    r = random.Random(5)
    lists = [[r.randint(0, 50256) for _ in range(r.randint(0, 30))] for _ in range(1000)]
    flat = np.array([i for x in lists for i in x])
    got = bpe.decode_texts(flat, np.array([len(x) for x in lists]), vocabulary)
    assert [x.decode() for x in got] == library.decode_batch(lists, skip_special_tokens=False)


def test_long_pieces_merge_like_short_ones(vocabulary):
    r = random.Random(7)
    for n in (1, 2, 3, 50, 700):
        data = np.array([r.choice(b"aabbcdethn") for _ in range(n)], np.uint8)
        ids, counts = bpe.merge(data, np.array([n]), vocabulary)
        assert counts.tolist() == [len(ids)]
        assert bpe.merge_long(vocabulary.byte_ids[data], vocabulary).tolist() == ids.tolist()


def test_other_files_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(path))


SCHEMA = "doc_id long, text string, ids string, n_tokens string, k0 long"


def test_round_trip(spark, library):
    texts = [*odd_texts()[:300], None, "same", "same"]
    data = [(None if i % 50 == 7 else i, t, "x", "y", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    want = []
    for r in data:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    rows = bpe.round_trip(docs, PATH).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(map(tuple, rows), key=lambda x: str(key(x))) == sorted(want, key=lambda x: str(key(x)))


def test_encode_and_decode_frames(spark, library):
    data = [(i, t, "x", "y", i) for i, t in enumerate([*odd_texts()[:100], None])]
    docs = spark.createDataFrame(data, SCHEMA).repartition(2)
    encoded = bpe.encode(docs, PATH)
    assert encoded.columns == ["doc_id", "text", "n_tokens", "k0", "ids"]
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in data}
    assert {r.doc_id: r.text for r in bpe.decode(encoded, PATH).collect()} == {r[0]: r[1] or "" for r in data}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 50256, 99999, -4, 64])], "k int, ids array<int>")
    assert {r.k: r.text for r in bpe.decode(odd, PATH).collect()} == {1: None, 2: "", 3: "<|endoftext|>a"}


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_query(spark, folder, library):
    rows = {r.doc_id: r for r in queries.op13_bpe(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
