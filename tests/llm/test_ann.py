import math

import numpy as np
import pytest

from strataform.llm import ann


def clustered(rng, n, dims, centres):
    c = rng.normal(size=(centres, dims))
    crowd = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, centres, n))  # a third of all in one region
    return (c[crowd] + 0.3 * rng.normal(size=(n, dims))).astype(np.float32) * rng.choice([0.25, 1, 40, 1000], (n, 1))


def frame(spark, x, extra=()):
    rows = [(f"c{i}", v.tolist(), i, 0.0) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "chunk_id string, embedding array<float>, cell int, similarity double")


def test_recall(spark):
    x = clustered(np.random.default_rng(0), 3000, 24, 100)
    df = frame(spark, x)
    ids = df.where("cell % 20 = 0").select("chunk_id")
    a = {(r.query_id, r.chunk_id) for r in ann.nearest(df, 24, ids, k=5).collect()}
    b = {(r.query_id, r.chunk_id) for r in ann.exact(df, 24, ids, k=5).collect()}
    assert len(b) == 150 * 5
    assert len(a & b) >= 0.9 * len(b)


def test_blocks_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 30)
    x = clustered(np.random.default_rng(1), 600, 16, 20)
    df = frame(spark, x)
    a = {(r.query_id, r.chunk_id) for r in ann.nearest(df, 16, k=5, probes=12).collect()}
    b = {(r.query_id, r.chunk_id) for r in ann.exact(df, 16, df.select("chunk_id"), k=5).collect()}
    assert len(a) == len(b) and len(a & b) >= 0.95 * len(b)


def test_dirty_rows(spark):
    good = [("a", [1.0, 0.0, 0.0], 0, 0.0), ("a", [1.0, 0.0, 0.0], 0, 0.0), ("b", [1000.0, 100.0, 0.0], 0, 0.0), ("c", [0.0, 1.0, 0.0], 0, 0.0), ("d", [-1e-30, 0.0, 0.0], 0, 0.0)]
    bad = [("e", None, 0, 0.0), ("f", [0.0, 0.0, 0.0], 0, 0.0), ("g", [math.nan, 1.0, 0.0], 0, 0.0), ("h", [math.inf, 1.0, 0.0], 0, 0.0), ("i", [1.0, 0.0], 0, 0.0), ("j", [1.0, None, 0.0], 0, 0.0), (None, [1.0, 0.0, 0.0], 0, 0.0)]
    df = spark.createDataFrame(good + bad, "chunk_id string, embedding array<float>, cell int, similarity double")
    rows = ann.nearest(df, 3, k=2).orderBy("query_id", "place").collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got["a"] == ["b", "c"] and got["d"] == ["c", "b"] and set(got) == {"a", "b", "c", "d"}
    assert {tuple(r) for r in ann.pairs(ann.nearest(df, 3, k=1)).collect()} == {("a", "b"), ("b", "c"), ("c", "d")}
    assert ann.nearest(df.limit(0), 3).count() == 0
    assert ann.nearest(df.where("chunk_id = 'a'"), 3).count() == 0


def test_codes_estimate_similarity():
    rng = np.random.default_rng(2)
    x = clustered(rng, 2000, 32, 30)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.fit(x, len(x), 10)
    lists = ann._nearest(x, index.centroids)
    left = ann._slices(x - index.centroids[lists])
    codes = np.stack([(left[:, m] @ index.books[m].T - (index.books[m] ** 2).sum(axis=1) / 2).argmax(axis=1) for m in range(left.shape[1])], axis=1)
    back = index.centroids[lists] + np.concatenate([index.books[m][codes[:, m]] for m in range(left.shape[1])], axis=1)
    assert np.abs((x[:50] @ x.T) - (x[:50] @ back.T)).mean() < 0.05
    assert index.vector_blocks.min() >= 1 and pytest.approx(1, abs=1e-5) == np.linalg.norm(index.centroids, axis=1).mean()


def test_exact_answers_every_id(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, rng.normal(size=(5200, 4)).astype(np.float32)).select("chunk_id", "embedding")
    got = ann.exact(df, 4, df.select("chunk_id"), k=1).select("query_id").distinct().count()
    assert got == 5200


def test_lists_beyond_the_sample_are_fitted_on_executors(spark, monkeypatch):
    """More lists than an eighth of the sample: recall holds, and the lists follow the number of vectors."""
    x = clustered(np.random.default_rng(4), 4000, 16, 60)
    df = frame(spark, x)
    seen, fit = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a, **more: seen.append(fit(*a, **more)) or seen[-1])
    ids = df.where("cell % 20 = 0").select("chunk_id")
    a = {(r.query_id, r.chunk_id) for r in ann.nearest(df, 16, ids, k=5, probes=12, sample=300).collect()}
    b = {(r.query_id, r.chunk_id) for r in ann.exact(df, 16, ids, k=5).collect()}
    assert len(seen[0].centroids) > 40 and ann.lists_for(4000) == 63
    assert len(a) == len(b) and len(a & b) >= 0.9 * len(b)


def test_several_vectors_of_an_id(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 0.1]), ("b", [1.0, 0.2]), ("b", [1.0, 0.3]), ("c", [0.1, 1.0]), ("d", [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    got = {}
    for r in ann.nearest(df, 2, k=2).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.similarity, 3)))
    assert got["a"] == [("b", 0.995), ("c", 0.995)]
    assert [n for n, _ in got["b"]] == ["a", "c"] and [n for n, _ in got["c"]] == ["a", "b"]
