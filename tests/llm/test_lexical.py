"""Ranked lexical search against a scan of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from daymart.llm import lexical

DOCS = "doc_id long, text string, score long, item int, rank int, terms string"
QUERIES = "item_id string, text string, doc_id long, score long"


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, queries, k):
    held = [(r[0], Counter(words(r[1])), len(words(r[1]))) for r in docs]
    held = [x for x in held if x[2]]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for q in queries:
        scores = []
        for key, c, size in held:
            m = 25 + (75 * size * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in Counter(words(q[1])).items() if t in c)
            if score > 0:
                scores.append((-score, key is not None, key or 0, key))
        out += [(q[0], i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores)[:k])]
    return Counter(out)


def data(seed=2, n=300):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "漢字", "ß9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i * 7 % n, " ".join(r.choices(vocabulary, weights, k=r.randint(1, 60)))) for i in range(n)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # copies: equal scores
    docs += [(5, docs[5][1]), (5, docs[6][1]), (None, docs[5][1]), (None, None), (2000, None), (2001, ""), (2002, " .,! "), (2003, "w3 W3-w3_" * 20000), (2004, "w" * 100000)]
    queries = [(f"q{i}", " ".join(r.choices(vocabulary, k=r.randint(1, 12)))) for i in range(30)]
    queries += [("all", " ".join(vocabulary * 3)), ("q1", "w1 w2 W1"), ("q1", "w1 w2 W1"), (None, "w5"), ("none", None), ("empty", "--"), ("unknown", "zzz"), ("copy", docs[5][1])]
    return docs, queries


def frames(spark, docs, queries, parts=4):
    d = spark.createDataFrame([(*x, 1, 2, 3, "t") for x in docs], DOCS).repartition(parts)
    return d, spark.createDataFrame([(*x, 1, 2) for x in queries], QUERIES)


def bag(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("postings, step, block, k", [(1 << 20, 1 << 13, 1_000_000, 10), (300, 1, 40, 3), (1, 64, 1_000_000, 10)])
def test_search(spark, monkeypatch, postings, step, block, k):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(lexical, "STEP", step)
    docs, queries = data()
    assert bag(lexical.search(*frames(spark, docs, queries), k=k, block_terms=block)) == brute(docs, queries, k)


def test_nothing(spark):
    docs, queries = data(n=20)
    none = [(1, None), (2, " ")]
    for a, b in ((docs, []), ([], queries), ([], []), (none, queries), (docs, [("x", None)])):
        assert bag(lexical.search(*frames(spark, a, b))) == Counter()


def test_text_ids(spark):
    docs = [(f"d{i}", "a b" if i % 2 else "b c") for i in range(30)]
    d = spark.createDataFrame([*docs, (None, "a b")], "doc_id string, text string")
    q = spark.createDataFrame([(1, "a")], "item_id int, text string")
    got = [tuple(r)[:3] for r in lexical.search(d, q, k=3).orderBy("rank").collect()]
    assert got == [(1, 1, None), (1, 2, "d1"), (1, 3, "d11")]


def test_intervals_leave_most_documents_unscored():
    """Only documents that may reach the k-th score are scored."""
    r = np.random.default_rng(4)
    n, terms = 20000, 30
    doc, term = np.nonzero(r.random((n, terms)) < np.geomspace(0.5, 0.001, terms))
    impact = r.integers(1, 100, len(doc)) * np.geomspace(1, 12, terms).astype(np.int64)[term]
    shard = lexical.Shard(n, doc, term, impact, terms)
    scored = []
    bounds = shard._bounds
    shard._bounds = lambda times, a, b: (scored.append(a.shape[1]), bounds(times, a, b))[1]
    score, found = shard.search(np.arange(terms), np.ones(terms, np.int64), 10, 0)
    whole = np.bincount(doc, impact, n).astype(np.int64)
    best = np.lexsort((np.arange(n), -whole))[:10]
    assert found.tolist() == best.tolist() and score.tolist() == whole[best].tolist()
    assert sum(scored) / 2 < n / 4
