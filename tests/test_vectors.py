import random
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.functions import numbers
from strataform.operators import vectors
from strataform.sources import blob, generators


@pytest.fixture(scope="module")
def compass(spark):
    s = math.sqrt(0.5)
    return spark.createDataFrame([("east", [1.0, 0.0], 1), ("northeast", [s, s], 1), ("north", [0.0, 1.0], 1), ("west", [-1.0, 0.0], 1)], "id string, embedding array<float>, rank int")


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, embedding array<float>")


def order(hits):
    return [r.id for r in hits.orderBy("query_id", "rank").collect()]


def test_ranking_and_scale(spark, compass):
    hits = vectors.search(compass, ask(spark, ("q", [1.0, 0.1])), 3)
    assert order(hits) == ["east", "northeast", "north"]
    big = vectors.search(compass, ask(spark, ("q", [1000.0, 100.0])), 3)
    assert [round(r.score, 6) for r in hits.orderBy("rank").collect()] == [round(r.score, 6) for r in big.orderBy("rank").collect()]


def test_limits_and_edges(spark, compass):
    q = ask(spark, ("q", [1.0, 0.0]))
    assert vectors.search(compass, q, 0).count() == 0
    assert vectors.search(compass, q, 99).count() == 4
    assert vectors.search(compass.limit(0), q, 3).count() == 0
    assert vectors.search(compass, q.limit(0), 3).count() == 0
    assert vectors.search(compass, ask(spark, ("q", None)), 3).count() == 0
    zero = vectors.search(compass, ask(spark, ("q", [0.0, 0.0])), 2)
    assert order(zero) == ["east", "north"] and all(r.score == 0 for r in zero.collect())
    with pytest.raises(Exception, match="dims"):
        vectors.search(compass, ask(spark, ("q", [1.0, 0.0, 0.0])), 2).collect()


def test_ties_come_by_id_over_all_batches(spark):
    rows = spark.createDataFrame([(f"i{n:03d}", [1.0, 0.0]) for n in range(200)], "id string, embedding array<float>").repartition(7)
    assert order(vectors.search(rows, ask(spark, ("q", [2.0, 0.0])), 4)) == ["i000", "i001", "i002", "i003"]


def test_blocks_of_queries(spark, compass, monkeypatch):
    q = ask(spark, *[(f"q{i}", [math.cos(i), math.sin(i)]) for i in range(9)])
    want = [(r.query_id, r.id, r.rank) for r in vectors.search(compass, q, 2).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    assert [(r.query_id, r.id, r.rank) for r in vectors.search(compass, q, 2).orderBy("query_id", "rank").collect()] == want


def test_cells_of_both_sides(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"v{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    rows += [(f"w{i}", rows[i][1]) for i in range(20)]  # repeated vectors tie and come in order of id
    table = spark.createDataFrame(rows, "id string, embedding array<float>")
    q = table.where("id like 'v1%'").select(F.col("id").alias("query_id"), "embedding")
    found = lambda: [tuple(r)[:2] + (r.rank,) for r in vectors.search(table, q, 3).orderBy("query_id", "rank").collect()]
    want = found()
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 30)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 50)
    assert found() == want and ("v10", "v10", 1) in want and ("v10", "w10", 2) in want


def test_resident_answers_as_the_search_does(spark):
    rng = random.Random(3)
    rows = [(f"v{i}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [("n", None)]
    table = spark.createDataFrame([*rows, ("z0", rows[0][1]), ("a0", rows[0][1])], "id string, embedding array<float>")
    held = vectors.Resident(table)
    for i in (0, 5, 77):
        want = [(r.id, round(r.score, 9)) for r in vectors.search(table, ask(spark, ("q", rows[i][1])), 4).orderBy("rank").collect()]
        assert [(n, round(s, 9)) for n, s in held.search(np.float32(rows[i][1]), 4)] == want
    assert [n for n, _ in held.search(rows[0][1], 3)] == ["a0", "v0", "z0"] and held.search(rows[0][1], 0) == []
    assert vectors.Resident(table.limit(0)).search([1.0] * 8, 3) == []
    with pytest.raises(ValueError):
        held.search([1.0], 3)
    with pytest.raises(ValueError):
        vectors.Resident(table, most=10)


def test_add_get_remove(spark, compass):
    t = compass.select(F.col("id").alias("chunk_id"), "embedding")
    gone = vectors.remove(t, t.where("chunk_id = 'north'").unionByName(t.where("chunk_id = 'north'")))
    assert gone.count() == 3 and vectors.get(t, gone).count() == 3
    assert vectors.remove(t, t.limit(0)).count() == 4
    assert vectors.add(gone, t.where("chunk_id = 'north'"), 2).count() == 4
    with pytest.raises(Exception, match="expected 3 dims"):
        vectors.add(t, t, 3).collect()


def test_unit_and_codes(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([-1.0, 0.5],)], "v array<float>")
    got = [r[0] for r in df.select(numbers.unit(F.col("v"))).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0]
    scale = numbers.quantized_scale(F.col("v"))
    codes = [r[0] for r in df.select(numbers.quantize(F.col("v"), scale)).collect()]
    assert codes == [[95, 127], [0, 0], [-127, 64]]
    assert [r[0] for r in spark.createDataFrame([(-2.5,), (2.5,), (-0.5,)], "x double").select(numbers.half_up(F.col("x"))).collect()] == [-2, 3, 0]
    _, own = blob.quantize(np.array([[3.0, 4.0], [0, 0], [-1, 0.5]]))
    assert own.tolist() == codes


def test_quantised_recall():
    x = generators.unit_vectors(2000, 64)
    back = blob.dequantize(*blob.quantize(x))
    a, b = (np.argsort(-(x[:40] @ m.T), axis=1)[:, :5] for m in (x, back))
    assert np.mean([len(set(p) & set(q)) / 5 for p, q in zip(a, b)]) > 0.95
