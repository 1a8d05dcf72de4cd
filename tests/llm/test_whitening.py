"""Whitening against dense linear algebra."""

import math

import numpy as np
import pytest

from daymart.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component int, x string, vec string"


def frame(spark, data, parts=3):
    return spark.createDataFrame([(i, v, 1, 2, "x", "y") for i, v in data], SCHEMA).repartition(parts)


def dense(data, k):
    """Rows of the answer by vec_id, component; vectors of one id are equal here."""
    x = {i: [math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for i, v in data if v is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted({tuple(v) for v in x.values()})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    mean = np.array([s // n for s in sums]), np.array([s % n / n for s in sums])
    centre = lambda v: (np.array(v) - mean[0]) - mean[1]
    c = np.array([centre(v) for v in fit])
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    k = int((e > 1e-12 * e[0]).sum())
    out = {}
    for i, v in x.items():
        y = centre(v) @ u / np.sqrt(np.where(e > 0, e, 1))
        for j in range(k):
            out[i, j + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), y[j], e[j] / np.trace(cov))
    return out


def compare(rows, want):
    got = {(r[0], r.component): r for r in rows}
    assert set(got) == set(want)
    flips = {}
    for key, (n, deviation, white, explained) in want.items():
        r = got[key]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.explained / explained - 1) < 1e-9 and r.identity_error < 1e-9 and r.residual < 1e-12
        if abs(white) > 1e-3:
            flips.setdefault(key[1], set()).add(bool(r.whitened * white < 0))
        assert abs(abs(r.whitened) - abs(white)) < 1e-7
    assert all(len(x) == 1 for x in flips.values())  # one sign per component


def cloud(seed=1, n=150, d=12, scale=1.0):
    r = np.random.default_rng(seed)
    return [(i, (r.standard_normal(d) * np.geomspace(3, 0.5, d) * scale).tolist()) for i in range(n)]


def test_whiten(spark):
    data = cloud()
    data += [(1000 + i, data[3][1]) for i in range(80)]  # a hot vector weighs once
    data += [(None, data[4][1]), (2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [1.0] * 11 + [float("inf")]), (2004, []), (2005, [1.0] * 5)]
    want = dense([x for x in data if x[0] != 2005], 5)
    compare(whitening.whiten(frame(spark, data), 5).collect(), want)


def test_repeated_rows_keep_their_rows(spark):
    data = cloud(n=20, d=3)
    got = whitening.whiten(frame(spark, data + data[:5]), 2)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"]
    assert got.count() == 50 and got.select("n").distinct().collect()[0].n == 20


def test_few_directions(spark):
    """Fewer components than asked for where there are fewer dimensions or no variance."""
    flat = [(i, [float(i), 2.0 * i, 0.0, 1.0]) for i in range(10)]
    compare(whitening.whiten(frame(spark, flat), 16).collect(), dense(flat, 16))
    assert whitening.whiten(frame(spark, flat), 16).count() == 10
    compare(whitening.whiten(frame(spark, cloud(d=3)), 16).collect(), dense(cloud(d=3), 16))


@pytest.mark.parametrize("data", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, []), (2, [])]])
def test_nothing_to_fit(spark, data):
    assert whitening.whiten(frame(spark, data)).collect() == []


def test_large_entries(spark):
    data = [(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [3e17, 1.0]), (4, [3.0, 2.0])]
    rows = whitening.whiten(frame(spark, data), 2).collect()
    assert {r.vec_id for r in rows} == {1, 2, 3, 4} and all(r.deviation is None for r in rows if r.vec_id == 1)


@pytest.mark.parametrize("d, k, shape", [(64, 16, "close"), (300, 16, "decay"), (200, 8, "equal"), (60, 16, "rank"), (10, 16, "decay"), (1, 16, "decay")])
def test_eigenpairs(d, k, shape):
    r = np.random.default_rng(d)
    x = r.standard_normal((2000, d))
    if shape == "decay":
        x *= np.geomspace(1, 0.01, d)
    if shape == "rank":
        x = r.standard_normal((2000, 5)) @ r.standard_normal((5, d))
    cov = x.T @ x / len(x)
    if shape == "equal":
        cov = np.diag(np.concatenate((np.full(20, 9.0), np.full(d - 20, 1.0))))
    e, u = whitening.leading(lambda b: cov @ b, d, k)
    want = np.linalg.eigvalsh(cov)[::-1][:k]
    assert np.abs(e - want).max() < 1e-12 * want[0]
    assert whitening._norms(cov @ u - u * e).max() < 2e-13 * want[0]
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12


def test_minres():
    r = np.random.default_rng(3)
    a = r.standard_normal((20, 20))
    a = a + a.T  # indefinite
    b = np.column_stack((r.standard_normal((20, 3)), np.zeros(20)))
    x = whitening.minres(lambda y: a @ y, b, steps=60, share=1e-12)
    assert np.abs(a @ x - b).max() < 1e-6


def test_query(spark, folder):
    data = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    rows = queries.op11_whitening(spark, folder)
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    from pyspark.sql import functions as F

    compare(rows.withColumn("residual", F.lit(0.0)).collect(), dense(data, 16))
