"""Top items per query by keyword points, against all pairs; few pairs may be looked at."""

import random
from collections import defaultdict

import pytest

from daymart.operators import retrieval as R


def world(seed, n_items, n_queries, n_words, hot):
    r = random.Random(seed)
    words = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(n_words)]
    weights = [hot / (i + 1) + 0.02 for i in range(n_words)]
    pick = lambda a, b: " ".join(r.choices(words, weights, k=r.randint(a, b)))
    metrics = [(f"{pick(1, 3)} m{i:04d}", pick(0, 6) or None, pick(0, 4)) for i in range(n_items)]
    queries = [(i, pick(1, 5)) for i in range(n_queries)] + [(9000, None), (9001, ""), (9002, "zz unknown"), (9003, words[0])]
    return metrics, queries


def points_of(metrics):
    out = defaultdict(dict)
    for name, description, expression in metrics:
        for text, p in ((name, 3), (description, 1), (expression, 1)):
            for w in set((text or "").split()):
                out[name][w] = out[name].get(w, 0) + p
    return out


def brute(queries, points, n):
    want = set()
    for key, text in queries:
        asked = set((text or "").split())
        scores = sorted((-sum(p for w, p in held.items() if w in asked), name) for name, held in points.items())
        want |= {(key, name, -s, i + 1) for i, (s, name) in enumerate([x for x in scores if x[0] < 0][:n])}
    return want


@pytest.mark.parametrize("seed, n_words, hot, n", [(1, 40, 1.0, 10), (2, 8, 1.0, 3), (3, 200, 0.1, 10), (4, 30, 20.0, 1), (5, 2, 1.0, 10)])
def test_rank_metrics(spark, seed, n_words, hot, n):
    metrics, queries = world(seed, 150, 120, n_words, hot)
    m = spark.createDataFrame(metrics, "metric string, description string, expression string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    got = {(r.query_id, r.metric, r.score, r["rank"]) for r in R.rank_metrics(q, m, "query_id", n=n).collect()}
    assert got == brute(queries, points_of(metrics), n)


def test_rank_entities_adds_the_bonus_once(spark):
    r = random.Random(7)
    words = [f"w{c}" for c in "abcdefgh"]
    entities = [(f"{r.choice(words)} {r.choice(words)} e{i}",) for i in range(60)]
    attributes = [(r.choice(entities)[0], r.choice(words), r.choice([None, *words])) for _ in range(200)]
    queries = [(i, " ".join(r.choices(words, k=r.randint(1, 4)))) for i in range(60)]
    want = set()
    for key, text in queries:
        asked = set(text.split())
        rows = []
        for (entity,) in entities:
            own = len(asked & set(entity.split()))
            hits = {w for e, a, d in attributes if e == entity for w in asked & {a, d}}
            per_word = sum(w in (a, d) for e, a, d in attributes if e == entity for w in asked)
            if own or hits:
                rows.append((-(3 * own + per_word + bool(hits)), entity))
        want |= {(key, e, -s, i + 1) for i, (s, e) in enumerate(sorted(rows)[:10])}
    e = spark.createDataFrame(entities, "entity string").distinct()
    a = spark.createDataFrame(attributes, "entity string, attribute string, description string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    got = {(x.query_id, x.entity, x.score, x["rank"]) for x in R.rank_entities(q, e, a, "query_id").collect()}
    assert got == want


def test_few_pairs_are_looked_at(spark):
    """All queries and items share a hot keyword; pairs must not grow with queries times items."""
    r = random.Random(3)
    items = [(f"hot i{i} w{i % 400}", None, None) for i in range(3000)]
    queries = [(i, f"hot {chr(97 + i % 20)}z w{r.randint(0, 399)}") for i in range(500)]
    q = spark.createDataFrame(queries, "query_id long, text string")
    m = spark.createDataFrame(items, "metric string, description string, expression string")
    points = R.metric_points(m)
    _, asked = R._keyword_sets(R.query_keywords(q, "query_id"), "query_id")
    sets = asked.select("_class").distinct().count()
    assert sets <= 20  # digits are no part of a keyword, so these queries share few sets
    assert R._candidates(asked, points, "metric", 10).count() <= sets * 30 < sets * 3000


def test_best_domains_equal_the_best_of_all_scores(spark):
    r = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "eta", "et"]
    catalog = [(f"d{i}", r.choice(["domain", "entity", "attribute", "metric", "odd"]), " ".join(r.choices(words, k=2))) for i in range(30)]
    queries = [(i, " ".join(r.choices(words, k=r.randint(1, 3)))) for i in range(40)] + [(99, None), (98, "none")]
    c = spark.createDataFrame(catalog, "domain_id string, kind string, text string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    want = {tuple(x) for x in R.match_domain(R.score_catalog(q, c, "query_id"), "query_id").collect()}
    assert {tuple(x) for x in R.best_domains(q, c, "query_id").collect()} == want and len(want) > 5
    assert R.score_catalog(q.limit(0), c, "query_id").collect() == []
