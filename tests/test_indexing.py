from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataform.operators import batching, indexing, merging
from strataform.operators.embedding import HASHED, Embedder, EmbeddingSpace, request_error, response_error

SCHEMA = "chunk_id string, doc_id string, text string, embedding array<float>"


def old(spark):
    return spark.createDataFrame([("d:0", "d", "one", [1.0]), ("d:1", "d", "two", [2.0]), ("d:2", "d", "three", [3.0]), ("e:0", "e", "one", [9.0])], SCHEMA)


def fresh(spark, *rows):
    return spark.createDataFrame(list(rows), "chunk_id string, doc_id string, text string")


def test_diff(spark):
    new = fresh(spark, ("d:0", "d", "top"), ("d:1", "d", "one"), ("d:2", "d", "two changed"), ("d:3", "d", "three"))
    got = {r.text: r.embedding for r in indexing.diff_chunks(new, old(spark)).collect()}
    assert got == {"top": None, "one": [1.0], "two changed": None, "three": [3.0]}
    assert tuple(indexing.reuse_counts(indexing.diff_chunks(new, old(spark))).first()) == (2, 2)
    other = fresh(spark, ("n:0", "n", "one"))
    assert indexing.diff_chunks(other, old(spark)).first().embedding is None
    twice = old(spark).unionByName(spark.createDataFrame([("d:9", "d", "one", [7.0])], SCHEMA))
    assert indexing.diff_chunks(fresh(spark, ("d:0", "d", "one")), twice).first().embedding == [7.0]


def test_add_is_insert_if_absent(spark):
    rows = fresh(spark, ("d:0", "d", "edited"), ("d:9", "d", "new"), ("d:9", "d", "new"))
    once = indexing.add_chunks(old(spark), rows, Embedder(EmbeddingSpace("t", "1", 1), lambda t: [[0.5]] * len(t)))
    got = {r.chunk_id: r.text for r in once.collect()}
    assert got["d:0"] == "one" and got["d:9"] == "new" and once.count() == 5
    assert indexing.add_chunks(once, rows).count() == 5


def test_update_replaces_and_reuses(spark):
    calls = EmbeddingSpace("t", "1", 1)
    ids = spark.createDataFrame([("d",), ("e",)], "doc_id string")
    got = indexing.update_documents(old(spark), fresh(spark, ("d:0", "d", "two"), ("d:1", "d", "fresh")), ids, Embedder(calls, lambda t: [[len(x)] for x in t]))
    assert {(r.chunk_id, r.text, r.embedding[0]) for r in got.collect()} == {("d:0", "two", 2.0), ("d:1", "fresh", 5.0)}


def test_remove_and_stats(spark):
    left = indexing.remove_documents(old(spark), spark.createDataFrame([("d",), ("x",)], "doc_id string"))
    assert tuple(indexing.index_stats(left).first()) == (1, 1)
    assert tuple(indexing.index_stats(left.limit(0)).first()) == (0, 0)


def test_batches(spark):
    o = batching.BatchOptions(2, 16_000)
    assert batching.plan_list([3, 1, 5, 2, 4], o) == [[1, 3], [0, 4], [2]]
    assert batching.plan_list([3, 1, 5, 2, 4], o, sort=False) == [[0, 1], [2, 3], [4]]
    assert batching.plan_list([]) == []
    assert [len(b) for b in batching.plan_list([400] * 10, batching.BatchOptions(32, 1000))] == [2] * 5
    assert batching.plan_list([5000, 10], batching.BatchOptions(32, 1000)) == [[1], [0]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=80), st.integers(1, 6), st.integers(1, 60))
def test_fold_equals_the_list_plan(lengths, size, chars):
    o = batching.BatchOptions(size, chars)
    rows = batching.fold(sorted(Counter(lengths).items()), o)
    want = {i: (b, p) for b, batch in enumerate(batching.plan_list(lengths, o)) for p, i in enumerate(batch)}
    number = Counter()
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        n, r = lengths[i], number[lengths[i]]
        number[n] += 1
        length, start, batch, per, place = max(x for x in rows if x[0] == n and x[1] <= r)
        assert (batch + (r - start) // per, place + (r - start) % per) == want[i]


def test_plan_in_buckets(spark):
    df = spark.createDataFrame([(i, "x" * (i % 4) if i % 7 else None, i) for i in range(100)], "idx long, text string, pos int")
    got = sorted(tuple(r) for r in batching.plan_batches(df, batching.BatchOptions(6, 9), bucket_rows=8).collect())
    lengths = [i % 4 if i % 7 else 0 for i in range(100)]
    assert got == sorted((i, b, p) for b, batch in enumerate(batching.plan_list(lengths, batching.BatchOptions(6, 9))) for p, i in enumerate(batch))
    assert batching.plan_batches(df.limit(0)).count() == 0


def test_embedder(spark):
    df = spark.createDataFrame([("budget sheet",), ("budget sheets",), ("zebra",), (None,), ("",)], "text string")
    v = {r.text: r.embedding for r in Embedder().embed(df).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    assert v[None] is None and len(v["zebra"]) == HASHED.dims and set(v[""]) == {0.0}
    assert dot("budget sheet", "budget sheets") > 0.6 > 0.2 > abs(dot("budget sheet", "zebra"))


def test_checks_of_requests_and_answers(spark):
    answer = "struct<vectors:array<array<double>>,dims:int,model:string>"
    space = EmbeddingSpace("m", "1", 2)
    rows = [((([[1.0, 2.0]]), 2, "m"), 1), ((([[1.0, 2.0]]), 2, "x"), 1), ((([[1.0, 2.0]]), 3, "m"), 1), ((([[1.0, 2.0]]), 2, "m"), 2), ((([[1.0]]), 2, "m"), 1), (None, 1), ((None, 2, "m"), 1)]
    df = spark.createDataFrame(rows, f"a {answer}, n int")
    assert [r[0] for r in df.select(response_error(F.col("a"), space, F.col("n"))).collect()] == [None, "model", "dims", "count", "vector length", "malformed", "malformed"]
    asked = spark.createDataFrame([(["a"],), ([],), (None,), (["a", ""],), (["a"] * 65,), (["x" * 8001],)], "t array<string>")
    assert [r[0] for r in asked.select(request_error(F.col("t"))).collect()] == [None, "empty", "empty", "blank text", "too many", "too long"]


def snapshot(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id string, chunk_id string, modified_time string")


def test_merge(spark):
    a = snapshot(spark, ("d", "d:0", "2025-01-01T00:00:00Z"), ("d", "d:1", "2025-01-01T00:00:00Z"), ("e", "e:0", "2025-01-01T00:00:00.500Z"))
    b = snapshot(spark, ("d", "d:0b", "2025-01-02T00:00:00Z"), ("e", "e:0b", "2025-01-01T00:00:00Z"), ("f", "f:0", None))
    ids = lambda df: sorted(r.chunk_id for r in df.collect())
    assert ids(merging.merge(a, b)) == ids(merging.merge(b, a)) == ["d:0b", "e:0", "f:0"]
    assert ids(merging.merge(a, a)) == ids(merging.merge(a, a.limit(0))) == ids(a)
    tie = snapshot(spark, ("d", "tie", "2025-01-01T01:00:00+01:00"))
    assert "tie" not in ids(merging.merge(a, tie)) and ids(merging.merge(tie, a)) == ["e:0", "tie"]


def test_progress(spark):
    docs = spark.createDataFrame([("d",), ("e",), ("f",), ("g",), ("g",)], "doc_id string")
    failures = spark.createDataFrame([("f", "lost"), ("d", "once")], "doc_id string, error string")
    assert tuple(indexing.progress(docs, old(spark), failures).first()) == (4, 2, 1, 4, "running")
    assert {r.doc_id for r in indexing.unfinished(docs, old(spark), failures).collect()} == {"g"}
    assert indexing.progress(docs.limit(0), old(spark).limit(0), failures).first().status == "idle"


def test_remaining_seconds(spark):
    df = spark.createDataFrame([(5, 10, 50, 10.0, True), (5, 10, 50, 1.0, True), (0, 10, 0, 10.0, True), (5, 10, 50, 10.0, False)], "dd int, td int, dc int, s double, r boolean")
    got = df.select(indexing.remaining_seconds(*[F.col(c) for c in ("dd", "td", "dc", "s", "r")])).collect()
    assert [r[0] for r in got] == [10, None, None, None]
