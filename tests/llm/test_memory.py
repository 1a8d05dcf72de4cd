"""What Python workers hold besides each other: the toxicity index and the pipeline's batches."""

import pickle

import numpy as np
import pyarrow as pa

import corpus_pipeline
from daymart.llm import toxicity
from daymart.llm.common import CHUNK_BYTES


def counted(n=600, terms=900, seed=6):
    r = np.random.default_rng(seed)
    lists = [np.unique(np.minimum(r.integers(0, terms, 120), r.integers(0, terms, 120))).astype(np.int32) for _ in range(n)]
    which, at = np.concatenate(lists), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    counts = np.where(r.random(len(which)) < 0.02, r.integers(1, 3000, len(which)), r.integers(1, 9, len(which))).astype(np.int32)
    vocabulary = toxicity.Vocabulary(pa.array([f"t{i:04d}".encode() for i in range(terms)], pa.binary()), 0.5 + r.random(terms))
    return vocabulary, which, counts, at


def test_index_from_counts_is_exact_and_small():
    """Postings and matrix take a few bytes each, and cosines are those of the whole vectors."""
    vocabulary, which, counts, at = counted()
    weight, lengths = vocabulary.weigh(which, counts, at)
    vectors = [(which[i:j], weight[i:j]) for i, j in zip(at[:-1], at[1:])]
    index = toxicity.BlockMaxIndex.of_counts(which, counts, at, vocabulary.idf, lengths, block=64)
    full = np.zeros((len(vectors), len(vocabulary.terms)))
    for e, (w, x) in enumerate(vectors):
        full[e, w] = x
    for q, (found, cosine) in enumerate(pickle.loads(pickle.dumps(index)).nearest_each(vectors, 9, list(range(len(vectors))))):
        want = np.round(full @ full[q], 12)
        want[q] = 0
        order = np.lexsort((np.arange(len(want)), -want))[:9]
        assert np.allclose(cosine, want[order], atol=1e-11) and np.allclose(want[found], want[order], atol=1e-11)
    index.nearest(*vectors[0], 3)
    assert len(index.often) and index.dense.itemsize <= 2
    assert len(pickle.dumps(index)) < 5 * len(which) + 20 * len(vocabulary.terms) + 20 * len(vectors) + 20_000


def test_pipeline_sends_python_a_chunk_at_once(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id AS doc_id", "repeat('some words of a text ', 200) AS text").coalesce(1)
    spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    try:
        corpus_pipeline.drop_toxic(spark, rows, str(tmp_path))
        seen = [r.n for r in rows.select("text").mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.set(name, before)
    assert len(seen) > 10 and max(seen) <= CHUNK_BYTES
