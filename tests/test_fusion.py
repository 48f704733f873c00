import pytest

from strataform.operators import fusion


def lists(spark, *ranked):
    return [spark.createDataFrame([(1, x, i + 1, 0.0) for i, x in enumerate(r)], "query_id int, id string, rank int, score double") for r in ranked]


def fuse(spark, *ranked, **options):
    rows = fusion.reciprocal_rank_fusion(lists(spark, *ranked), **options).orderBy("fused_rank").collect()
    return [(r.id, r.score) for r in rows]


def test_arithmetic(spark):
    got = dict(fuse(spark, ["a", "b"], ["a", "c"]))
    assert got["a"] == pytest.approx(2 / 61) and got["b"] == pytest.approx(1 / 62) and len(got) == 3


def test_ties_by_recency_then_first_list(spark):
    newest = spark.createDataFrame([("b", 2000), ("a", 1000)], "id string, recency long")
    assert [x for x, _ in fuse(spark, ["a"], ["b"], recency=newest)] == ["b", "a"]
    assert [x for x, _ in fuse(spark, ["z"], ["a"])] == ["z", "a"]


def test_k_decides_between_one_top_and_two_middles(spark):
    one = ["top", *[f"x{i}" for i in range(3)], "mid"]
    two = [*[f"y{i}" for i in range(4)], "mid"]
    assert fuse(spark, one, two)[0][0] == "mid"
    assert fuse(spark, one, two, k=1)[0][0] == "top"


def test_empty(spark):
    assert fuse(spark, []) == []


def test_collapse(spark):
    fused = spark.createDataFrame([(1, "d1:0", 0.3, 1), (1, "gone", 0.25, 2), (1, "d1:1", 0.2, 3), (1, "d2:0", 0.1, 4)], "query_id int, id string, score double, fused_rank int")
    chunks = spark.createDataFrame([("d1:0", "d1"), ("d1:1", "d1"), ("d2:0", "d2")], "chunk_id string, doc_id string")
    rows = fusion.best_chunk_per_document(fused, chunks, 10).orderBy("place").collect()
    assert [(r.chunk_id, r.place) for r in rows] == [("d1:0", 1), ("d2:0", 2)]
    assert fusion.best_chunk_per_document(fused, chunks, 0).count() == 0
    assert fusion.candidate_depth(10) == 50 and fusion.candidate_depth(20) == 100
