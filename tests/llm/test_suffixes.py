"""Removal of repeated strings against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from daymart.llm.suffixes import equal_suffixes, remove_repeats, sliding_min

SCHEMA = "doc_id long, text string, token long, digest long, body string"


def rows():
    r = random.Random(3)

    def word(n):
        return "".join(r.choice("abcdeé ") for _ in range(n))

    shared = [word(n) for n in (30, 60, 90, 150, 400)]
    out = [(i, "".join(r.choice([word(r.randint(0, 60)), r.choice(shared)]) for _ in range(r.randint(0, 6)))) for i in range(80)]
    out += [(100, None), (101, ""), (102, "a" * 700), (103, "ab" * 300), (104, out[3][1]), (104, out[3][1]), (None, out[5][1]), (105, "x" * 49 + "y")]
    return [(i, t, 1, 2, "b") for i, t in out]


def brute(data, window):
    count = Counter()
    texts = [(r[0], (r[1] or "").encode()) for r in data]
    for _, b in texts:
        for p in range(len(b) - window + 1):
            count[b[p : p + window]] += 1
    out = Counter()
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if count[b[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[(i, len(b), sum(gone), bytes(b"\0" + gone).count(b"\0\1"), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("window, hot", [(50, 20000), (50, 0), (61, 2), (12, 20000), (200, 20000)])
def test_removal(spark, window, hot):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    got = remove_repeats(docs, window, hot_pieces=hot).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute(rows(), window)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_no_rows(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sorting_kernels():
    r = np.random.default_rng(2)
    x = r.integers(0, 50, 300).astype(np.uint64)
    for w in (1, 7, 300):
        assert sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(300 - w + 1)]
    data = r.integers(0, 2, 400).astype(np.uint8)
    data[200:] = data[:200]
    start, group = np.arange(0, 380), np.arange(0, 380) // 200
    for depth in (5, 8, 12, 16):
        text = data.tobytes()
        seen = Counter((g, text[s : s + depth]) for s, g in zip(start, group))
        assert equal_suffixes(data, start, group, depth).tolist() == [seen[(g, text[s : s + depth])] > 1 for s, g in zip(start, group)]


def test_texts_of_equal_short_hash_stay_apart(spark):
    """Null ids and equal 32-bit hashes: what one text repeats must not be cut from the other."""
    from pyspark.sql import functions as F

    passage = "".join(random.Random(1).choice("abcdefghij ") for _ in range(301))
    many = spark.range(250_000)
    one = many.select(F.concat(F.lit(passage), F.col("id").cast("string")).alias("x"))
    other = many.select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.sha2(F.concat_ws("-", "id", k), 256)), "").alias("y"))
    pair = one.withColumn("h", F.hash("x")).join(other.withColumn("h", F.hash("y")), "h").first()
    data = [(None, pair.x, 1, 2, "b"), (None, pair.y, 1, 2, "b"), (7, passage + "!", 1, 2, "b"), (None, pair.y[::-1], 1, 2, "b")]
    got = remove_repeats(spark.createDataFrame(data, SCHEMA), 200).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute(data, 200)
    assert sorted(r.n_removed for r in got) == [0, 0, 301, 301]
