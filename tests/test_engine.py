import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.functions import hashing, text
from strataform.operators import evaluation, exporting, presentation
from strataform.operators.embedding import HASHED, EmbeddingSpace
from strataform.plans.hybrid import HybridSearcher, build_index
from strataform.sources import blob, catalog, generators
from strataform.sources.snapshots import SnapshotStore
from strataform.streaming.debounce import debounce
from strataform.streaming.sync import CHANGE, IndexSync, change_stream

DOC = "application/vnd.google-apps.document"
CORPUS = [
    ("d1", "Travel policy", "# Travel\n\nBook trains early. Hotels need approval by the travel desk.\n\n## Refunds\n\nKeep every receipt for the refund.", "2025-01-01T00:00:00Z"),
    ("d2", "Backup runbook", "# Backups\n\nThe nightly job copies all volumes. Restore tests happen every month.", "2025-01-02T00:00:00Z"),
    ("d3", "Hiring plan", "# Hiring\n\nWe look for two engineers and one designer this spring.", "bad"),
    ("d4", "Empty", "", None),
    ("d5", None, None, None),
]
LABELS = [(1, "hotel approval", "d1"), (2, "restore volumes", "d2"), (3, "designer", "d3"), (4, "travl polcy", "d1"), (5, "backup", "d2")]


@pytest.fixture(scope="module")
def searcher(spark):
    docs = spark.createDataFrame([(*r, 1.0) for r in CORPUS], "doc_id string, doc_name string, text string, modified_time string, score double")
    index = build_index(docs)
    index.chunks = index.chunks.cache()
    return HybridSearcher(index)


def test_search(spark, searcher):
    q = spark.createDataFrame([(1, "hotel approval"), (2, " "), (3, "nightly job"), (4, None)], "query_id int, text string")
    rows = searcher.search(q, 2).orderBy("query_id", "place").collect()
    assert {(r.query_id, r.place, r.doc_id) for r in rows if r.place == 1} == {("1", 1, "d1"), ("3", 1, "d2")}
    assert all(len({r.doc_id for r in rows if r.query_id == i}) == 2 for i in ("1", "3"))
    assert rows[0].snippet.startswith("Book trains early.")
    assert searcher.search(q, 0).count() == 0


def test_modes_are_evaluated(spark, searcher):
    q = spark.createDataFrame([(i, t) for i, t, _ in LABELS], "query_id int, text string")
    truth = spark.createDataFrame([(str(i), d) for i, _, d in LABELS], "query_id string, doc_id string")
    scores = {r["mode"]: r for r in evaluation.summary(searcher.rankings(q), truth).collect()}
    assert set(scores) == {"semantic", "lexical", "hybrid"}
    assert scores["hybrid"].recall_at_5 == 1.0 and scores["hybrid"].mrr >= 0.9


def test_equal_questions_are_searched_once(spark, searcher, monkeypatch):
    asked = []
    for name in ("semantic", "words"):
        own = getattr(searcher, name)
        monkeypatch.setattr(searcher, name, lambda q, depth, name=name, own=own: asked.append((name, q.count())) or own(q, depth))
    q = spark.createDataFrame([(i, ("hotel approval", "nightly job")[i % 2]) for i in range(20)] + [(20, " "), (21, None), (22, "restore"), (22, "designer")], "query_id int, text string")
    rows = sorted((r.mode, int(r.query_id), r["rank"], r.doc_id) for r in searcher.rankings(q).collect())
    assert asked == [("semantic", 4), ("words", 4)]
    of = lambda i: [(m, r, d) for m, j, r, d in rows if j == i]
    assert {j for _, j, _, _ in rows} == {*range(20), 22}
    assert all(of(i) == of(i % 2) for i in range(20)) and of(0) != of(1)
    assert ("semantic", 1, "d1") in of(0) and ("lexical", 1, "d2") in of(1)
    assert {d for m, _, d in of(22) if m == "lexical"} == {"d2", "d3"}  # an id with two texts asks both


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["c"]), (["a", "b", "c"], ["a", "c", "z"]), (["a"], []), ([], ["a"])], "r array<string>, t array<string>")
    got = df.select(evaluation.recall_at(F.col("r"), F.col("t"), 3).alias("c"), evaluation.reciprocal_rank(F.col("r"), F.col("t")).alias("m"), evaluation.recall_at(F.col("r"), F.col("t"), 1).alias("one")).collect()
    assert [tuple(round(x, 4) for x in r) for r in got] == [(1.0, 0.3333, 0.0), (0.6667, 1.0, 0.3333), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    ranked = spark.createDataFrame([("hybrid", 1, "a", 1), ("lexical", 1, "b", 1), ("lexical", 1, "a", 2)], "mode string, query_id int, doc_id string, rank int")
    truth = spark.createDataFrame([(1, "a"), (1, "a")], "query_id int, doc_id string")
    scores = evaluation.summary(ranked, truth)
    assert {r["mode"]: (r.recall_at_1, r.mrr) for r in scores.collect()} == {"hybrid": (1.0, 1.0), "lexical": (0.0, 0.5)}
    assert evaluation.verdict(scores).first().best and not evaluation.verdict(scores, "lexical").first().best
    assert evaluation.summary(ranked.limit(0), truth).count() == 0
    lines = [r.line for r in presentation.score_table(scores.orderBy("mode")).collect()]
    assert lines[0] == "hybrid" + " " * 4 + "     1.000" * 3


def index_of(spark, *docs):
    rows = [(f"{d}:0", d, d.upper(), 0, ["A"], f"text of {d} {t}", t, np.ones(384).tolist()) for d, t in docs]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, doc_name string, seq int, breadcrumbs array<string>, text string, modified_time string, embedding array<float>")


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    a, b = SnapshotStore(spark, path, HASHED), SnapshotStore(spark, path, HASHED)
    assert a.load().reason == "no saved index" and not a.stats()["loaded"]
    old, new = "2025-01-01T00:00:00Z", "2025-02-01T00:00:00Z"
    assert a.save(index_of(spark, ("d", old), ("e", old))) == 1
    assert b.save(index_of(spark, ("d", new), ("f", old))) == 2  # b hadn't seen version 1: it merges
    rows = {r.doc_id: r.modified_time for r in a.load().index.collect()}
    assert rows == {"d": new, "e": old, "f": old}
    assert a.stats() == {"loaded": True, "index_size": 3, "doc_count": 3, "reason": ""}
    one = a.load().index.first().embedding
    assert sum(x * x for x in one) == pytest.approx(1, abs=1e-5)
    c = SnapshotStore(spark, path, EmbeddingSpace("other", "1", 384))
    assert not c.load().loaded and "made for" in c.load().reason
    assert c.save(index_of(spark, ("z", old))) == 3 and not a.load().loaded  # an unusable one is replaced
    assert a.load(2).index.count() == 3  # readers may pin a version
    assert c.switch(HASHED) and not c.switch(HASHED)


def test_blob():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chunks = [{"id": f"d:{i}", "text": "é" * i} for i in range(40)]
    data = blob.pack(blob.Snapshot("m", "1", x, chunks))
    back = blob.unpack(data)
    assert (back.model_id, back.revision, back.chunks) == ("m", "1", chunks)
    assert np.abs(back.vectors - x).max() < 0.01
    for bad, why in ((data[:10], "short"), (b"XXXX" + data[4:], "not an index"), (data[:4] + b"\x02\x00" + data[6:], "version"), (data[:60] + bytes([data[60] ^ 1]) + data[61:], "checksum"), (data[:-5], "short")):
        with pytest.raises(blob.BlobError, match=why):
            blob.unpack(bad)
    with pytest.raises(blob.BlobError):
        blob.pack(blob.Snapshot("m", "1", x[:1], chunks))
    assert hashing.fnv1a(b"") == 0x811C9DC5 and hashing.fnv1a(b"a") == 0xE40C292C and hashing.fnv1a(b"foo", b"bar") == 0xBF9CF968


def write(spark, path, *changes):
    rows = [(s, f, k == "remove", (f, f, DOC, "2025-01-01T00:00:00Z", False) if k == "write" else None) for s, f, k in changes]
    spark.createDataFrame(rows, CHANGE).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_and_retries(spark, tmp_path):
    bodies = {"a": "# A\n\nfirst text", "b": "second text", "c": None}
    feed, root = f"{tmp_path}/feed", f"file://{tmp_path}/index"

    def fetch(ids):
        df = spark.createDataFrame([(k, v) for k, v in bodies.items()], "doc_id string, text string")
        got = ids.join(df, "doc_id", "left")
        return got.select("doc_id", F.col("doc_id").alias("doc_name"), "text", F.lit("2025-01-01T00:00:00Z").alias("modified_time"), F.when(F.col("text").isNull(), "lost").alias("error"))

    sync = IndexSync(spark, root, fetch)
    write(spark, feed, (1, "a", "write"), (2, "b", "write"), (3, "c", "write"))
    sync.start(change_stream(spark, feed), f"{tmp_path}/offsets").awaitTermination()
    assert {r.chunk_id for r in sync.index().collect()} == {"a:0", "b:0"}
    assert [r.doc_id for r in sync.failures().collect()] == ["c"]
    before = sync.table.current()
    sync.start(change_stream(spark, feed), f"{tmp_path}/offsets").awaitTermination()
    assert sync.table.current() == before  # nothing new, nothing done
    bodies["c"] = "found at last"
    write(spark, feed, (4, "b", "remove"))
    sync.start(change_stream(spark, feed), f"{tmp_path}/offsets").awaitTermination()
    assert {r.chunk_id for r in sync.index().collect()} == {"a:0", "c:0"} and sync.failures().count() == 0
    done = sync.table.current()
    assert sync.apply(spark.read.schema(CHANGE).parquet(feed), 0) == done  # a replayed batch is known


def test_baseline(spark, tmp_path):
    feed = f"{tmp_path}/feed"
    fetch = lambda ids: ids.select("doc_id", F.col("doc_id").alias("doc_name"), F.lit("body").alias("text"), F.lit(None).cast("string").alias("modified_time"), F.lit(None).cast("string").alias("error"))
    sync = IndexSync(spark, f"file://{tmp_path}/index", fetch)
    write(spark, feed, (1, "a", "write"))
    assert sync.baseline(spark.read.schema(CHANGE).parquet(feed)) == 1 and sync.index().count() == 0
    write(spark, feed, (2, "b", "write"))
    sync.start(change_stream(spark, feed), f"{tmp_path}/offsets").awaitTermination()
    assert [r.doc_id for r in sync.index().collect()] == ["b"]
    assert sync.baseline(spark.read.schema(CHANGE).parquet(feed)) == 2


def test_debounce(spark):
    rows = [("u", "2025-01-01 00:00:00.000", "b"), ("u", "2025-01-01 00:00:00.100", "bu"), ("u", "2025-01-01 00:00:00.200", "bud"), ("u", "2025-01-01 00:00:01", "x"), ("v", "2025-01-01 00:00:00", "y")]
    df = spark.createDataFrame(rows, "k string, t string, v string").withColumn("t", F.col("t").cast("timestamp"))
    got = {(r.k, r.last_value, r.n) for r in debounce(df, "k", "t", "v").collect()}
    assert got == {("u", "bud", 3), ("u", "x", 1), ("v", "y", 1)}


def test_export(spark):
    docs = spark.createDataFrame([(f"d{i}",) for i in range(6)], "doc_id string")

    def fetch(doc_id):
        if doc_id == "d3":
            raise ValueError("gone")
        return doc_id * 2

    out = exporting.export_documents(docs, fetch).cache()
    good, bad = exporting.split_failures(out)
    assert good.count() == 5 and [tuple(r) for r in bad.collect()] == [("d3", "ValueError: gone")]
    assert tuple(exporting.export_report(out).first()) == (5, 1, 20)

    def fatal(doc_id):
        raise exporting.Fatal("signed out")

    with pytest.raises(Exception, match="signed out"):
        exporting.export_documents(docs, fatal).collect()
    waits, tries = [], iter([OSError(), OSError(), None])

    def call():
        e = next(tries)
        if e:
            raise e
        return "ok"

    assert exporting.with_retries(call, lambda e: True, sleep=waits.append) == "ok" and len(waits) == 2
    assert exporting.backoff(2, chance=lambda: 0.0) == 2.0 and exporting.backoff(0, 7.0) == 7.0
    with pytest.raises(KeyError):
        exporting.with_retries(lambda: {}["x"], lambda e: False)


def test_texts(spark):
    df = spark.createDataFrame([("  a 　 b \n",), ("x" * 179 + " yz",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.snippet(F.col("t"))).collect()] == ["a b", "x" * 179 + "…", "", None]
    assert [r[0] for r in df.select(text.is_blank(F.col("t"))).collect()] == [False, False, True, True]
    assert [r[0] for r in spark.createDataFrame([("<a & \"b\" 'c'>",)], "t string").select(text.xml_escape(F.col("t"))).collect()] == ["&lt;a &amp; &quot;b&quot; &apos;c&apos;&gt;"]
    times = ["2025-01-01T00:00:00Z", "2025-01-01T01:00:00.5+01:00", "2025-01-01t00:00:00z", "2025-01-01", "2025-13-01T00:00:00Z", "n/a", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(text.epoch_millis(F.col("t"))).collect()]
    assert got == [1735689600000, 1735689600500, 1735689600000, 0, 0, 0, 0, 0]


def test_presentation(spark):
    df = spark.createDataFrame([("a<b", ["X", "Y & Z"], "s" * 120), ("n", [], "short")], "n string, b array<string>, s string")
    lines = [r[0] for r in df.select(presentation.suggestion(F.col("n"), F.col("b"), F.col("s"))).collect()]
    assert lines == ["<match>a&lt;b</match> <dim>X › Y &amp; Z</dim> — " + "s" * 100, "<match>n</match> — short"]
    n = spark.createDataFrame([(1, 3, None), (0, 0, 30), (1, 2, 90)], "d int, t int, s int")
    assert [tuple(r) for r in n.select(presentation.percent(F.col("d"), F.col("t")), presentation.remaining_text(F.col("s"))).collect()] == [(33, "estimating…"), (0, "30 s"), (50, "2 min")]


def test_sources(spark, tmp_path):
    files = spark.createDataFrame([("a", "A", DOC, "2", None), ("b", "B", DOC, "3", False), ("c", "C", DOC, "4", True), ("d", "D", "image/png", "5", None)], "id string, name string, mime_type string, modified_time string, trashed boolean")
    assert [r.id for r in catalog.list_documents(files).collect()] == ["b", "a"]
    (tmp_path / "a.md").write_text("# A\n\nx")
    bodies = catalog.read_bodies(spark, str(tmp_path))
    assert {(r.id, r.text) for r in catalog.with_bodies(catalog.list_documents(files), bodies).collect()} == {("a", "# A\n\nx"), ("b", None)}
    rows = {r.idx: r.text.split() for r in generators.bench_corpus(spark, 3).collect()}
    assert len(rows[0]) == 8 and len(rows[2]) == 8 + 74 and rows[1][0] == "token1"
    assert np.allclose(np.linalg.norm(generators.unit_vectors(5, 7), axis=1), 1, atol=1e-6)


def test_entry_has_sql_for_known_queries_only(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 250
    json.dumps(e.oracle_sql())
