"""N-gram join, toxicity and the pipeline's stages against plain Python."""

import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from daymart.llm import mixing, ngram_join, sharding, toxicity
from daymart.llm.common import chunks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest long, hits string, n long, score double"


def texts(seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(60)]
    out = []
    for k in range(70):  # near copies at many distances from one text
        t = list(base)
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice(words)
        out.append(" ".join(t[: r.randint(50, 60)]))
    common = " ".join(r.choice(words) for _ in range(20))
    out += [common + " " + " ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(40)]
    out += [" ".join(r.choice(words) for _ in range(r.randint(1, 8))) for _ in range(20)]
    out += ["", None, " \n", "one", "One", "one two", "ONE two three", "a b c d", "a  b\tc d e", "x " * 4000, "x " * 4001, "no break here now ok", out[3], out[3], out[3].upper()]
    return out


def rows():
    out = [(i, t, "en", f"s{i % 3}", len(t or ""), 1, "h", 2, 0.5) for i, t in enumerate(texts())]
    return [*out, out[10], out[10], (None, out[12][1], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(data, k, percent):
    sets = [shingles(r[1], k) for r in data]
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return sets, [find(i) for i in range(len(data))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4)


@pytest.mark.parametrize("k, percent, small", [(4, 85, 32), (4, 85, 2), (5, 80, 10**9), (2, 50, 3)])
def test_components(docs, k, percent, small, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    data = rows()
    sets, root = brute_components(data, k, percent)
    want = Counter()
    for i, r in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if root[j] == root[i] and data[j][0] is not None]
        want[(r[0], len(sets[i]), min(ids, default=None) if sets[i] else r[0])] += 1
    got = ngram_join.ngram_components(docs, k, percent)
    assert Counter(tuple(x) for x in got.collect()) == want


def test_links_span_without_all_pairs(docs):
    join = ngram_join.NgramJoin(docs, 4, 85)
    links = join.links().collect()
    classes = join.classes.count()
    sets, root = brute_components(rows(), 4, 85)
    groups = {frozenset(s) for s in sets if s}
    big = max(Counter(r for r, s in zip(root, sets) if s).values())
    assert len(groups) == classes and len(links) < big * (big - 1) / 4


def test_join_without_open_classes_starts_few_jobs(spark):
    """Texts that share nothing need no hub rounds, and the counts come to the driver as one byte a cell."""
    import pyarrow as pa

    docs = spark.createDataFrame([(i, " ".join(f"u{i}x{k}" for k in range(30))) for i in range(20)], "doc_id long, text string")
    tracker, before = spark.sparkContext.statusTracker(), None
    before = set(tracker.getJobIdsForGroup(None))
    got = ngram_join.ngram_components(docs).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 27 for r in got) and len(got) == 20
    assert len(set(tracker.getJobIdsForGroup(None)) - before) < 30
    slices = pa.RecordBatch.from_arrays([pa.array([3, 3], pa.int32()), pa.array([zlib.compress(np.full(8, 2**31, "<u4").tobytes())] * 2, pa.binary())], names=["slice", "cells"])
    (out,) = ngram_join._add_slices(iter([slices]))
    assert out.column(1).to_pylist() == [bytes([255] * 8)]


def test_one_per_group(docs, spark):
    data = rows()
    sets, root = brute_components(data, 5, 80)
    want = Counter()
    for g in set(root):
        members = [data[i] for i in range(len(data)) if root[i] == g]
        if sets[g]:
            want[min((m for m in members if m[0] is not None), default=members[0])[0]] += 1
        else:
            want[members[0][0]] += len(members)
    kept = ngram_join.one_per_group(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == want
    none = spark.createDataFrame([], SCHEMA)
    assert ngram_join.one_per_group(none).count() == 0 and ngram_join.ngram_components(none).count() == 0


def test_shingle_kernel():
    import pyarrow as pa

    data = [t.encode() for t in (x or "" for x in texts())]
    for limit in (1, 500, 1 << 20):
        seen = {}
        k = 0
        for part in chunks(pa.array(data, pa.binary()), limit):
            grams, at = ngram_join.shingle_sets(part, 4)
            for i in range(len(part)):
                mine = grams[at[i] : at[i + 1]].tolist()
                want = shingles(data[k].decode(), 4)
                assert len(mine) == len(want) and mine == sorted(mine)
                assert seen.setdefault(frozenset(mine), want) == want
                k += 1
        assert k == len(data)


def test_block_max_index_is_exact():
    r = np.random.default_rng(3)
    vectors = []
    for _ in range(700):
        which = np.sort(r.choice(60, r.integers(1, 8), replace=False))
        w = r.random(len(which))
        vectors.append((which, w / np.sqrt((w**2).sum())))
    index = toxicity.BlockMaxIndex(vectors, 60, block=16)
    dense = np.zeros((700, 60))
    for e, (which, w) in enumerate(vectors):
        dense[e, which] = w
    for q in range(0, 700, 7):
        e, s = index.nearest(*vectors[q], 15, without=q)
        cosine = np.round(dense @ dense[q], 12)
        cosine[q] = 0
        order = np.lexsort((np.arange(700), -cosine))[:15]
        order = order[cosine[order] > 0]
        assert e.tolist() == order.tolist() and np.allclose(s, cosine[order])


def test_block_max_index_with_rare_and_frequent_terms(monkeypatch):
    """Terms in and out of the matrix give the same cosines; a pickled index makes its matrix anew."""
    import pickle

    monkeypatch.setattr(toxicity, "FREQUENT", 5)
    r = np.random.default_rng(4)
    vectors = []
    for _ in range(150):
        which = np.unique(np.minimum(r.integers(0, 40, 9), r.integers(0, 40, 9)))
        w = r.random(len(which))
        vectors.append((which, w / np.sqrt((w**2).sum())))
    index = toxicity.BlockMaxIndex(vectors, 40, block=16)
    dense = np.zeros((150, 40))
    for e, (which, w) in enumerate(vectors):
        dense[e, which] = w
    index.nearest(*vectors[0], 3)
    assert 0 < len(index.dense) <= 5 and len(pickle.dumps(index)) < len(pickle.dumps(index.dense)) + len(pickle.dumps(vectors))
    for q, (found, cosine) in enumerate(pickle.loads(pickle.dumps(index)).nearest_each(vectors, 7)):
        want = np.round(dense @ dense[q], 12)
        order = np.lexsort((np.arange(150), -want))[:7]
        assert found.tolist() == order[want[order] > 0].tolist() and np.allclose(cosine, want[found])


def test_toxicity_terms_by_hash():
    """Whole chunks of texts give the words and word beginnings that one text after the other gives."""
    import pyarrow as pa

    r = random.Random(2)
    data = [(t or "").encode() for t in texts()] + ["Été ÉTÉ naïveté 漢字漢字 a1b2c3d4 x_y-z".encode(), b"\xff\xfe abcdefgh ABCDE abcd* *", b"", b"toxicity toxic toxins toxi tox"]
    examples = r.sample(data, 30) + [b"toxicology toxically", "naïveté".encode()]
    terms = sorted(set().union(*[toxicity.terms_of(t) for t in examples]))
    vocabulary = toxicity.Vocabulary(pa.array(terms, pa.binary()), np.ones(len(terms)))
    number = {t: i for i, t in enumerate(terms)}
    for limit in (1, 300, 1 << 20):
        got = []
        for part in chunks(pa.array(data, pa.binary()), limit):
            which, counts, at = vocabulary.counts(part)
            got += [dict(zip(which[i:j].tolist(), counts[i:j].tolist())) for i, j in zip(at[:-1], at[1:])]
        assert got == [{number[t]: n for t, n in toxicity.terms_of(x).items() if t in number} for x in data]
    none = toxicity.Vocabulary(pa.array([], pa.binary()), np.zeros(0))
    assert [len(v[0]) for part in chunks(pa.array(data, pa.binary())) for v in none.vectors(part)] == [0] * len(data)


def labelled(spark, flip=False):
    r = random.Random(9)
    words = [f"v{i}" for i in range(300)]
    data, labels = [], []
    import zlib

    for i in range(900):
        bad = r.random() < 0.3
        t = [r.choice(words) for _ in range(r.randint(5, 40))]
        if bad:
            t.insert(r.randrange(len(t)), r.choice(["nasty", "Vile", "rotten", "grumpfing", "grumpfen", "grumpfs"]))
        held = zlib.crc32(str(i).encode()) % 3 == 1
        data.append((i, " ".join(t), "en", None, 1, 1, "h", 2, 0.5))
        labels.append((i, int(bad) ^ (flip and held), 1))
    data += [(1000, None, *data[0][2:]), (1001, "", *data[0][2:]), (1001, "", *data[0][2:]), (None, "nasty words", *data[0][2:]), (1002, "NASTY " * 5000, *data[0][2:])]
    labels += [(None, 1, 1), (5000, 1, 1), (3, None, 1), (0, labels[0][1], 1)]
    return spark.createDataFrame(data, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int, score int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    got = toxicity.report(docs, labels).select("doc_id", "held_out", "score", "predicted")
    joined = got.join(labels.dropDuplicates(["doc_id"]), "doc_id").filter("held_out").select("predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in joined if r.toxic is not None) / len(joined)
    assert len(joined) > 200 and right > 0.97
    first = Counter(tuple(r) for r in got.collect())
    assert sum(first.values()) == docs.count()
    assert {r[3] for r in first if r[0] == 1002} == {1} and {r[3] for r in first if r[0] is None} == {1}
    assert all(0 <= r[2] <= 1 for r in first) and all(r[3] == 0 for r in first if r[0] in (1000, 1001))
    docs, flipped = labelled(spark, flip=True)
    assert Counter(tuple(r) for r in toxicity.report(docs, flipped).select("doc_id", "held_out", "score", "predicted").collect()) == first
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in first.elements() if r[3] == 0)


def test_toxicity_without_data(spark):
    docs, labels = labelled(spark)
    assert toxicity.report(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.report(docs, labels.limit(0)).collect()} == {0.0}


def words_of_class(spark, rows):
    """Documents 0, 1, ... of (text, toxic) and their labels."""
    docs = spark.createDataFrame([(i, t, "en", None, 1, 1, "h", 2, 0.5) for i, (t, _) in enumerate(rows)], SCHEMA)
    return docs, spark.createDataFrame([(i, bad, 1) for i, (_, bad) in enumerate(rows)], "doc_id long, toxic int, score int")


def test_toxicity_of_moderately_telling_words(spark):
    """No word is four times as frequent in one class; together they tell it."""
    r = random.Random(4)
    rows = []
    for _ in range(900):
        bad = int(r.random() < 0.4)
        rows.append((" ".join(f"{'ab'[r.random() < (0.3 if bad else 0.7)]}{r.randrange(60)}" for _ in range(40)), bad))
    got = toxicity.report(*words_of_class(spark, rows)).filter("held_out").collect()
    right = sum(r.predicted == rows[r.doc_id][1] for r in got) / len(got)
    found = sum(r.predicted for r in got if rows[r.doc_id][1]) / sum(rows[r.doc_id][1] for r in got)
    assert len(got) > 200 and right > 0.9 and found > 0.85 and all(r.terms for r in got)


def test_toxicity_of_rare_words(spark):
    """A word that about ten toxic examples have counts."""
    r = random.Random(5)
    rows = [(" ".join(f"v{r.randrange(300)}" for _ in range(20)), 0) for _ in range(300)]
    bad = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(30)]
    rows += [(f"{bad[k]} {bad[k - 1]} " + " ".join(f"v{r.randrange(300)}" for _ in range(4)), 1) for k in range(30) for _ in range(8)]
    got = toxicity.report(*words_of_class(spark, rows)).filter("held_out").collect()
    assert sum(r.predicted == rows[r.doc_id][1] for r in got) > 0.95 * len(got)


def test_toxicity_copies():
    """Only true copies within a label go; a row that went drops no others."""
    base = np.arange(100, dtype=np.uint64)
    near = np.arange(5, 105, dtype=np.uint64)  # 95 of 105 shared with base
    far = np.arange(9, 109, dtype=np.uint64)  # 91 of 109 shared with base, 96 of 104 with near
    farther = np.arange(12, 112, dtype=np.uint64)  # 88 of 112 shared with base, 93 of 107 with near
    shared = np.concatenate((base[:50], np.arange(500, 550, dtype=np.uint64)))
    none = np.zeros(0, np.uint64)
    sets = [base, near, far, farther, shared, base, shared, none, none]
    assert toxicity.apart(sets, [0, 0, 0, 0, 0, 1, 1, 0, 1]) == [0, 3, 4, 5, 6, 7, 8]
    assert toxicity.apart([], []) == []


def test_toxicity_of_shared_passages(spark):
    """A passage that stands in texts of both classes makes them no copies; copies don't use up the examples."""
    r = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(50))
    words = lambda n: " ".join(f"v{r.randrange(400)}" for _ in range(n))
    rows = [(f"{passage} {words(30)}", 0) for _ in range(200)]
    rows += [(f"{passage} {words(15)} {r.choice(['nasty', 'vile', 'rotten'])} {words(14)}", 1) for _ in range(200)]
    rows += [(f"{passage} spam", 0)] * 300
    docs, labels = words_of_class(spark, rows)
    got = toxicity.report(docs, labels).filter("held_out").collect()
    assert sum(x.predicted == rows[x.doc_id][1] for x in got) > 0.95 * len(got)
    model = toxicity.fit(docs, labels, examples=100)
    assert Counter(model.labels.tolist()) == {0: 100, 1: 100}


def test_mix_rows(docs):
    decided = Counter()
    for r in mixing.mix(docs).collect():
        if r["size"]:
            decided[r.doc_id, r["size"]] += r.whole + (1 if r.part > 0 and 2 * r.part >= r["size"] else 0)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    mixed = mixing.repeat(docs)
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, size(r.text)) for r in mixed.collect()) == Counter({k: v for k, v in decided.items() if v})


def test_sharded_rows(docs):
    want = Counter((r.doc_id, r["size"], r.shard, r.slot) for r in sharding.shard(docs).collect())
    got = sharding.sharded(docs)
    assert got.columns == [*docs.columns, "shard", "slot"]
    assert Counter((r.doc_id, len((r.text or "").encode()) + 1, r.shard, r.slot) for r in got.collect()) == want


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "mixing", "sharding"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == (columns if name != "sharding" else [*columns, "shard", "slot"])
        out[name] = docs.collect()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = toxicity.report(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    assert {r.doc_id for r in out["toxicity"]} == {r.doc_id for r in scores.filter("predicted = 0").collect()}
    data = [tuple(r) for r in out["toxicity"]]
    sets, root = brute_components(data, 5, 80)
    want = {min(data[i][0] for i in range(len(data)) if root[i] == g) for g in set(root)}
    assert Counter(r.doc_id for r in out["ngram_join"]) == Counter(want)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() for w in [split(r.text)] for i in range(max(1, len(w) - 9))}
    before = {r.doc_id: split(r.text) for r in out["ngram_join"]}
    assert {r.doc_id for r in out["decontamination"]} == set(before)
    for r in out["decontamination"]:
        w = before[r.doc_id]
        hit = {k for i in range(len(w)) if tuple(w[i : i + 10]) in windows for k in range(i, i + 10)}
        assert split(r.text) == [x for i, x in enumerate(w) if i not in hit] and r.n_chars == len(r.text)
    assert {r.doc_id for r in out["mixing"]} <= set(before) and len(out["sharding"]) == len(out["mixing"])
    final = corpus_pipeline.run(spark, folder)
    assert Counter(tuple(r) for r in final.collect()) == Counter(tuple(r) for r in out["sharding"])


def test_entry_without_this_part(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and sum(q.startswith("op") for q in entry.queries()) == 13
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("daymart.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    importlib.reload(entry)
    try:
        assert "pipeline" not in entry.queries() and "j12_orphans" in entry.queries() and "pipeline" not in entry.oracle_sql()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
