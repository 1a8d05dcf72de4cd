"""Exact dedup, token files, licence scan, sharding, mixing and decontamination against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from daymart.llm import decontamination, exact, fmindex, licenses, mixing, queries, sharding, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, hits string, body string, size long"
BENCH = "item_id long, text string"


def rows(n=60, seed=1):
    r = random.Random(seed)
    words = "the mit under license apache version 2 cc by nc alpha beta gamma delta été Über 漢字 x1".split()
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(n)]
    texts += [None, "", " ", "\n\t", "under the MIT license", texts[3], texts[3], texts[3], "a" * 5000, "ab " * 20000, "Ünder the mit\x00license"]
    out = [(i, t, "en", None if i % 7 == 0 else f"src{i % 4}", len(t or ""), i, "x", "y", 3) for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, "lost", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_exact_dedup(docs, bits):
    key = (lambda c: F.xxhash64(c)) if bits == 64 else (lambda c: F.shiftleft(F.pmod(F.xxhash64(c), F.lit(1 << bits)), 64 - bits) if bits else F.lit(7).cast("long"))
    groups = defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max([i for i in ids if i is not None], default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    got = exact.exact_dedup(docs, key=key, bucket_keys=3).drop("bucket")
    assert bag(got) == want


def test_directory_splits_only_full_buckets(spark):
    keys = spark.range(0, 40).select(F.col("id").alias("h")).union(spark.range(3).select(F.shiftleft("id", 62)))
    cells = {r.cell: (r.local_depth, r.bucket) for r in exact.directory(keys, 4, 4).collect()}
    assert cells == {0: (4, 16), 4: (2, 5), 8: (1, 3)}


def test_exact_dedup_empty(empty):
    assert exact.exact_dedup(empty).count() == 0


def test_shards(docs, empty):
    got = sharding.shard(docs, 8).collect()
    tree = {"root": [("region-0", 4.0), ("region-1", 4.0)]}
    for g in range(2):
        tree[f"region-{g}"] = [(f"rack-{2 * g + k}", 2.0) for k in range(2)]
    for k in range(4):
        tree[f"rack-{k}"] = [(f"shard-{2 * k + j}", 1.0) for j in range(2)]

    def place(i):
        at = "root"
        while at in tree:
            def draw(kid):
                h = xxhash.xxh64(int(i).to_bytes(8, "little", signed=True), seed=42).intdigest() if i is not None else 42
                u = ((xxhash.xxh64(kid[0].encode(), seed=h).intdigest() >> 11) + 0.5) / 2**53
                return -math.log(u) / kid[1]
            at = min(tree[at], key=draw)[0]
        return int(at.split("-")[1])

    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), "key", place(r[0])) for r in rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard) for r in got) == want
    assert all(r.grown_shard in (r.shard, 8) for r in got) and any(r.grown_shard == 8 for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shard(empty).count() == 0


def test_weight_change_moves_only_below(spark):
    ids = spark.range(3000)
    before = sharding.HashTree.regular(8)
    after = sharding.HashTree.regular(8, weights={0: 1.5})
    moved = ids.select(before.place(F.col("id")).alias("a"), after.place(F.col("id")).alias("b")).filter("a != b").collect()
    assert moved and all(r.b < 4 for r in moved)  # into the region of shard 0 only


def fill(sizes, weights, budget, cap):
    target, open_ = {}, dict(weights)
    while open_:
        level = budget / sum(open_.values())
        full = [s for s in open_ if cap * sizes[s] <= level * open_[s]]
        if not full:
            return target | {s: level * w for s, w in open_.items()}
        for s in full:
            target[s] = cap * sizes[s]
            budget -= target[s]
            del open_[s]
    return target


def test_mixing(docs, empty):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += size(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"], r.source_size) for r in got) == Counter((r[0], size(r[1]), sizes[r[3]]) for r in rows())
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert bag(mixing.mix(docs.repartition(5))) == bag(mixing.mix(docs))
    assert mixing.mix(empty).count() == 0


def brute_contamination(docs, bench, width):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, text in bench:
        w = split(text)
        if w:
            k = min(width, len(w))
            for i in range(len(w) - k + 1):
                windows[tuple(w[i : i + k])].add("null" if item is None else str(item))
    out = Counter()
    for r in docs:
        w, hit, items = split(r[1]), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if own := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    items |= own
        out[(r[0], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))] += 1
    return out


@pytest.mark.parametrize("block_words", [1_000_000, 12])
def test_contamination(spark, docs, empty, block_words):
    texts = [r[1] for r in rows() if r[1]]
    bench = [(1, texts[0][5:60]), (2, "mit license"), (10, "ab ab ab ab ab ab"), (None, "the the"), (3, ""), (4, None), (2, "2 cc"), (5, texts[9])]
    table = spark.createDataFrame(bench, BENCH)
    got = decontamination.report(docs, table, window=4, block_words=block_words)
    assert bag(got) == brute_contamination(rows(), bench, 4)
    assert decontamination.report(empty, table).count() == 0
    none = decontamination.report(docs, table.limit(0)).collect()
    assert len(none) == len(rows()) and not any(r.contaminated for r in none)


def test_decontaminate_cuts_runs(spark, docs):
    table = spark.createDataFrame([(1, "under the mit license")], BENCH)
    kept = decontamination.decontaminate(docs, table)
    assert kept.columns == docs.columns and kept.count() == len(rows())
    texts = Counter(r[1] for r in rows())
    for r in kept.collect():
        assert (r.text in texts) or "license" not in (r.text or "").split()[:1]
    assert decontamination._cut("Say UNDER the, mit license! now", np.array([1, 2, 3, 4])) == "Say ! now"


def test_fm_index():
    r = np.random.default_rng(0)
    for n, s in [(1, 2), (40, 3), (300, 4), (300, 200)]:
        seq = np.append(r.integers(2, s + 2, n), [1])
        seq[n // 2 :] = seq[: len(seq) - n // 2]
        order = fmindex.suffix_array(np.append(seq, 0))
        whole = np.append(seq, 0).tolist()
        assert order.tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])
        index = fmindex.FMIndex(seq, s + 2)
        pats = np.array([seq[i : i + 3] for i in range(max(1, n - 3))] + [[s + 2] * 3]) if n > 3 else np.array([[seq[0]]])
        low, high = index.search(pats)
        for p, a, b in zip(pats.tolist(), low, high):
            want = [i for i in range(len(seq)) if seq[i : i + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_licenses(docs, empty):
    got = licenses.report(docs)
    want = Counter()
    for r in rows():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        first, last = (min(at)[0], max(at)[0]) if at else (None, None)
        want[(r[0], len(w), len(at), first, last, ",".join(sorted({x for _, x in at})))] += 1
    assert bag(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == want
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.report(empty).count() == 0


def test_license_phrases_inside_template_matches(spark):
    """A phrase counts where it ends a longer match of a template or of another phrase."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    r = random.Random(8)
    pool = [t.split() for t in [*licenses.PHRASES, *licenses.TEMPLATES.values()]]
    texts = ["Licensed under the Apache License, Version 2.0", "the apache license version 2 apache license version 2", licenses.TEMPLATES["apache-2"]]
    for _ in range(400):
        pieces = [p[r.randrange(len(p)) :][: r.randint(1, 9)] for p in (r.choice(pool) for _ in range(r.randint(1, 8)))]
        texts.append(" ".join(w for p in pieces for w in p))
    for phrases in (licenses.PHRASES, {"the mit license": "a", "under the mit license": "b", "license": "c", "mit license": "d", "a copy": "e", "of the license": "f"}):
        want = {}
        for i, t in enumerate(texts):
            w = cut(t)
            at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
            first, last = (min(at)[0], max(at)[0]) if at else (None, None)
            want[i] = (len(w), len(at), first, last, ",".join(sorted({x for _, x in at})))
        got = licenses.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), phrases=phrases)
        assert {x.doc_id: (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in got.collect()} == want
        assert want[0][1] > 0 and want[1][1] > 1


def test_license_chains():
    s = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    text = licenses.TEMPLATES["mit"].split()
    text[20] = "CHANGED"
    del text[30:32]
    n, places, chains = s.scan(("zzz " * 5 + " ".join(text) + " zzz").encode())
    best = max(chains, key=lambda c: c[3])
    assert s.labels[best[2]] == "mit" and best[0] == 5 and best[1] == 5 + len(text) and best[3] > 0.9 and not places
    a = licenses.SuffixAutomaton([[1, 2, 3, 1, 2], [2, 3, 1], [1, 2, 3, 1, 2]])
    text = [1, 2, 3, 1, 2, 2, 3, 1, 1, 2, 9, 3, 1, 2]
    seqs = [[1, 2, 3, 1, 2], [2, 3, 1]]
    for end, (state, length) in enumerate(a.statistics(text), 1):
        fits = [n for n in range(end + 1) for q in seqs for i in range(len(q)) if n and q[i : i + n] == text[end - n : end] and len(q[i : i + n]) == n]
        assert length == max(fits, default=0)
        ends = {(t, i + length) for t, q in enumerate([*seqs, seqs[0]]) for i in range(len(q)) if length and q[i : i + length] == text[end - length : end]}
        assert {(t, e) for t, e in a.states[state].ends} == ends if length else True


def test_token_files(spark, docs, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokens.write(docs, str(tmp_path / "a"), path)
    got = sorted(tokens.read(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(r.doc_id is not None, r.doc_id or 0) for r in got]
    ids = {r: [*tokenizer.encode(r, add_special_tokens=False).ids, 0] for r in {x[1] or "" for x in rows()}}
    digest = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r[0], len(x := ids[r[1] or ""]), digest(x)) for r in rows())
    at = 0
    for r in got:
        assert r.start == at and digest(np.frombuffer(r.ids, "<u4")) == r.ids_crc32
        at += r.n_tokens
    tokens.write(empty, str(tmp_path / "b"), path)
    assert tokens.read(spark, str(tmp_path / "b")).count() == 0


def test_pieces_encode_like_whole_texts():
    import public_tokenizers

    e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), "<u4")
    odd = ["", " ", "a b", "a  b", "a \n b", "a\n b", " a", "a ", "it's  <|endoftext|> x", "x <|endoftext|>", "1 2  3", "é　 ü", "a​ b", "don 't", "\n", "a\n\n b c", "a,b", "a, b.", "a.. b", "x. ,y", "(a). b", "é.\nB", ".a", "a_. b", "1,000.5", "a\x00b c", "x\n,y", "½, Ⅷ.", "a.\u0301 b"]
    got = e.encode(odd)
    for text, ids in zip(odd, got):
        assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_huffman():
    r = np.random.default_rng(1)
    for n, bits in [(1, 4), (2, 4), (300, 9), (5000, 13)]:
        counts = np.floor(1e9 / np.arange(1, n + 1) ** 3).astype(np.int64) + (np.arange(n) % 3)
        lengths = tokens.code_lengths(counts, bits)
        used = lengths[lengths > 0].astype(float)
        assert lengths.max() <= bits and (0.5**used).sum() <= 1 and ((lengths > 0) == (counts > 0)).all()
        ids = r.choice(np.flatnonzero(counts), 1000)
        a, b = tokens.pack(ids, lengths, tokens.canonical(lengths)), tokens.pack(ids[:65], lengths, tokens.canonical(lengths))
        got = tokens.Decoder(lengths).unpack([(*a, 1000), (*b, 65)])
        assert got[0].tolist() == ids.tolist() and got[1].tolist() == ids[:65].tolist()
    # optimal against plain Huffman when the limit does not bind
    import heapq

    counts = r.integers(1, 1000, 200)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    cost, k = 0, 1000
    while len(heap) > 1:
        (a, _), (b, _) = heapq.heappop(heap), heapq.heappop(heap)
        cost, k = cost + a + b, k + 1
        heapq.heappush(heap, (a + b, k))
    assert int((tokens.code_lengths(counts, 30).astype(np.int64) * counts).sum()) == cost


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, folder, name):
    from oracle import bag as cells
    from oracle import connect

    df = queries.QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    cur = connect(folder).execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    assert cells(got, df.columns, order) == cells(cur.fetchall(), names, order)


@pytest.mark.parametrize("shards", [1, 5, 6, 7, 8, 11])
def test_growth_moves_rows_into_the_new_shard_only(spark, shards):
    tree = sharding.HashTree.regular(shards)
    twice = tree.grown().grown()
    ids = spark.range(4000)
    places = ids.select(tree.place(F.col("id")).alias("a"), tree.grown().place(F.col("id")).alias("b"), twice.place(F.col("id")).alias("c")).collect()
    assert all(r.b in (r.a, shards) and r.c in (r.b, shards + 1) for r in places)
    moved = sum(r.b != r.a for r in places) / len(places)
    assert abs(moved - 1 / (shards + 1)) < 0.03


def test_directory_deepens_with_the_keys(spark):
    """No bucket holds more keys than asked for, however many there are, and no task counts all cells."""
    assert exact.depth_for(0, 2048) == exact.depth_for(10**6, 2048) == 12
    assert exact.depth_for(10**10, 2048) == 25
    keys = spark.range(20000).select(F.xxhash64("id").alias("h"))
    cells = exact.directory(keys, 16, exact.depth_for(20000, 16))
    held = keys.select(F.shiftrightunsigned("h", 64 - exact.depth_for(20000, 16)).alias("cell")).join(cells, "cell").groupBy("bucket").count()
    top = held.agg(F.max("count"), F.sum("count")).first()
    assert top[0] <= 16 and top[1] == 20000
    assert "Window" not in cells._jdf.queryExecution().executedPlan().toString()


def test_deep_directories_are_joined(docs, monkeypatch):
    want = bag(exact.exact_dedup(docs).drop("bucket"))
    monkeypatch.setattr(exact, "BROADCAST_DEPTH", 0)
    assert bag(exact.exact_dedup(docs, bucket_keys=1).drop("bucket")) == want
