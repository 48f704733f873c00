import random
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataform.operators import changefeed, incremental
from strataform.sources.versions import VersionedTable, VersionTaken

DOC = changefeed.DOCUMENT_MIME
SCHEMA = "seq long, file_id string, removed boolean, file struct<id:string,name:string,mime_type:string,modified_time:string,trashed:boolean>, received_at timestamp, tombstone int"


def change(seq, file_id, kind):
    file = {"write": (file_id, f"v{seq}", DOC, None, None), "trash": (file_id, "x", DOC, None, True), "other": (file_id, "x", "image/png", None, False), "untyped": (file_id, "x", None, None, False)}.get(kind)
    return (seq, file_id, {"remove": True, "write": None}.get(kind, False), file, None, 0)


def truth(changes):
    state = {}
    for seq, file_id, removed, file, *_ in sorted(changes, key=lambda c: (c[0] is None, c[0] or 0)):
        if file_id is None or seq is None:
            continue
        gone = removed or (file and file[4]) or (file is not None and file[2] != DOC)
        if gone:
            state.pop(file_id, None)
        elif file is not None:
            state[file_id] = seq
    return state


def applied(spark, changes, target=None):
    target = changefeed.apply_changes(spark.createDataFrame(changes, SCHEMA), target)
    return {r.file_id: r.seq for r in changefeed.existing_files(target).collect()}, target


def test_cases(spark):
    kinds = [("a", ["write"]), ("b", ["write", "remove"]), ("c", ["remove", "write"]), ("d", ["write", "trash"]), ("e", ["write", "other"]), ("f", ["write", "untyped"]), ("g", ["write", "empty"]), ("h", ["empty"]), (None, ["write"])]
    changes = [change(10 * i + j, f, k) for i, (f, ks) in enumerate(kinds) for j, k in enumerate(ks)] + [change(None, "z", "write")]
    got, _ = applied(spark, changes)
    assert got == truth(changes) == {"a": 0, "c": 21, "g": 60}
    assert applied(spark, [])[0] == {}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.sampled_from("aaab"), st.sampled_from(["write", "remove", "trash", "other", "empty"])), max_size=60), st.randoms())
def test_order_repeats_and_parts_do_not_matter(spark, drawn, rng):
    once = {s: (s, f, k) for s, f, k in drawn}
    changes = [change(*c) for c in once.values()]
    shuffled = changes + rng.sample(changes, len(changes) // 2)
    rng.shuffle(shuffled)
    got, _ = applied(spark, shuffled)
    assert got == truth(changes)
    half = len(shuffled) // 2
    _, target = applied(spark, shuffled[half:])
    got, target = applied(spark, shuffled[:half], target)
    assert got == truth(changes) and target.current() == 2
    assert applied(spark, shuffled, target)[0] == truth(changes)


def test_collapse(spark):
    rows = [(1, "a", "upsert"), (2, "a", "remove"), (3, "a", None), (1, "b", "remove"), (5, "b", "upsert"), (1, None, "remove")]
    df = spark.createDataFrame(rows, "n int, k string, intent string")
    assert {(r.k, r.intent, r.last_order) for r in changefeed.collapse_changes(df, "k", "n", "intent").collect()} == {("a", "remove", 2), ("b", "upsert", 5)}


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.current() == 0 and t.read() is None and t.manifest() is None
    place = t.write(spark.range(3).toDF("id"))
    assert t.read() is None  # written but not published
    assert t.publish({"data": place}, note="x") == 1 and t.read().count() == 3 and t.manifest()["note"] == "x"
    other = t.write(spark.range(5).toDF("id"))
    assert t.publish({"data": other}, expected=1) == 2
    with pytest.raises(VersionTaken):
        t.publish({"data": place}, expected=1)
    assert t.read(version=1).count() == 3 and t.read().count() == 5


def test_one_of_two_writers_wins(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    place = t.write(spark.range(1).toDF("id"))
    won = []

    def publish():
        try:
            won.append(t.publish({"data": place}, expected=0))
        except VersionTaken:
            pass

    threads = [threading.Thread(target=publish) for _ in range(6)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert won == [1] and t.current() == 1


def test_next_run(spark):
    meta = spark.createDataFrame([("a", "2025-01-02T00:00:00Z"), ("a", "2025-01-01T00:00:00Z"), ("b", "2025-01-01T00:00:00.5+01:00"), ("c", "n/a"), ("d", None), ("e", "2025-01-01T00:00:00Z"), (None, "2025-01-01T00:00:00Z")], "id string, modified_time string")
    feed = spark.createDataFrame([("f", 1), ("f", 7), ("g", 3), ("h", 2), (None, 9), ("i", None)], "file_id string, seq long")
    log = [(1, "a", None, "2025-01-01T00:00:00Z", "done"), (1, "b", None, "2024-12-31T23:00:00.500Z", "done"), (1, "d", None, "2025-01-01T00:00:00Z", "done"), (2, "e", None, "2025-01-01T00:00:00Z", "done"), (1, "e", None, "bad", "done"), (1, "f", 6, None, "done"), (1, "g", 3, None, "done"), (1, "h", 2, None, "failed"), (None, "h", 2, None, "done")]
    runs = [(1, "started", 1), (1, "succeeded", 3), (1, "failed", 2), (2, "succeeded", 1), (2, "rolled_back", 2), (3, None, 1)]
    log_df = spark.createDataFrame(log, "run_id long, file_id string, last_seq long, modified_time string, outcome string")
    runs_df = spark.createDataFrame(runs, "run_id long, status string, status_at int")
    got = {(r.record_kind, r.file_id) for r in incremental.next_run(meta, feed, log_df, runs_df).collect()}
    assert got == {("listing", "a"), ("listing", "c"), ("listing", "e"), ("feed", "f"), ("feed", "h"), ("feed", "i")}
    assert incremental.next_run(meta.limit(0), feed.limit(0), log_df, runs_df).count() == 0
    assert incremental.next_run(meta, feed, log_df.limit(0), runs_df.limit(0)).count() == 9


def test_runs_neither_skip_nor_repeat(spark, tmp_path):
    target = incremental.IncrementalTarget(VersionedTable(spark, f"file://{tmp_path}/t"))
    source = lambda *rows: spark.createDataFrame(list(rows), "key string, version long, body string")
    seen = []

    def work(pending):
        rows = pending.collect()
        seen.append(sorted((r.key, r.version) for r in rows))
        return spark.createDataFrame([(r.key, r.version, r.body.upper()) for r in rows], "key string, version long, body string")

    first = source(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n"))
    target.run(first, work)

    def dies(pending):
        raise RuntimeError("lost")

    second = source(("a", 2, "y"), ("a", 2, "y"), ("b", 3, "w"), ("c", 1, "v"))
    with pytest.raises(RuntimeError):
        target.run(second, dies)
    assert target.table.current() == 1
    target.run(second, work)
    target.run(second, work)
    assert seen == [[("a", 2), ("b", 1)], [("b", 3), ("c", 1)], []]
    assert {(r.key, r.body) for r in target.rows().collect()} == {("a", "Y"), ("b", "W"), ("c", "V")}


def test_runs_take_in_keys_without_version(spark, tmp_path):
    target = incremental.IncrementalTarget(VersionedTable(spark, f"file://{tmp_path}/t"))
    source = lambda *rows: spark.createDataFrame(list(rows), "key string, version long, body string")
    rows = lambda: sorted((r.key, r.version, r.body) for r in target.rows().collect())
    keys = lambda df: sorted(r.key for r in target.pending(df).collect())
    first = source(("a", None, "x"), ("a", None, "x"), ("b", None, "old"), ("b", 1, "y"), (None, None, "n"))
    target.run(first, lambda pending: pending)
    assert rows() == [("a", None, "x"), ("b", 1, "y")]
    assert keys(first) == ["a"]  # the target has no version for it
    target.run(source(("a", None, "z"), ("b", None, "old")), lambda pending: pending)
    assert rows() == [("a", None, "z"), ("b", 1, "y")]
    known = source(("a", None, "z"), ("a", 2, "w"))
    target.run(known, lambda pending: pending)
    assert rows() == [("a", 2, "w"), ("b", 1, "y")] and keys(known) == [] and keys(source(("a", None, "z"))) == []


def test_random_feed_equals_truth(spark):
    rng = random.Random(4)
    changes = [change(s, "hot" if rng.random() < 1 / 3 else f"f{rng.randrange(50)}", rng.choice(["write", "write", "remove", "trash", "empty"])) for s in range(3000)]
    rng.shuffle(changes)
    assert applied(spark, changes)[0] == truth(changes)


def test_ties_do_not_depend_on_arrival(spark):
    """Rows of one sequence and receipt with different contents: the same one wins in any order and in any batches."""
    def row(name):
        return (5, "a", False, ("a", name, DOC, None, None), None, 0)

    names = []
    for order in ([["x", "y"]], [["y", "x"]], [["x"], ["y"]], [["y"], ["x"]]):
        target = None
        for part in order:
            target = changefeed.apply_changes(spark.createDataFrame([row(n) for n in part], SCHEMA), target)
        names.append(changefeed.existing_files(target).first().name)
    assert names == ["y"] * 4


def test_only_touched_buckets_are_written(spark):
    changes = [change(s, f"f{s}", "write") for s in range(200)]
    _, target = applied(spark, changes)
    before = target.bucketed()
    got, target = applied(spark, [change(900, "f7", "remove")], target)
    after = target.bucketed()
    assert len(got) == 199 and sum(before["places"][b] != after["places"].get(b) for b in before["places"]) == 1
    grown = changefeed.apply_changes(spark.createDataFrame([change(901, "g", "write")], SCHEMA), target, buckets=16)
    assert grown.bucketed()["buckets"] == 16 and changefeed.existing_files(grown).count() == 200


def test_an_engine_may_spill(spark, monkeypatch):
    rows = [(f"f{i % 900}", i, i, False, f"f{i % 900}", "n" * 50, DOC, "t", False) for i in range(30_000)]
    out = [b for b in changefeed.upsert_batches(iter(spark.createDataFrame(rows, changefeed.STATE).toArrow().to_batches()))]
    assert sum(b.num_rows for b in out) == 900 and min(x for b in out for x in b.column(1).to_pylist()) == 29_100


def test_keys_without_output_are_done(spark, tmp_path):
    target = incremental.IncrementalTarget(VersionedTable(spark, f"file://{tmp_path}/t"))
    source = spark.createDataFrame([("a", 1, "x"), ("b", 1, "drop")], "key string, version long, body string")
    target.run(source, lambda pending: pending.where("body <> 'drop'"))
    assert [r.key for r in target.rows().collect()] == ["a"] and target.pending(source).count() == 0
    later = source.withColumn("version", F.lit(2).cast("long")).withColumn("body", F.when(F.col("key") == "a", "drop").otherwise("y"))
    target.run(later, lambda pending: pending.where("body <> 'drop'"))
    assert [(r.key, r.version, r.body) for r in target.rows().collect()] == [("b", 2, "y")]


def test_a_target_goes_on_from_what_was_taken_in(spark, tmp_path):
    target = incremental.IncrementalTarget(VersionedTable(spark, f"file://{tmp_path}/t"))
    target.adopt(spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "key string, version long"))
    source = spark.createDataFrame([("a", 3, "x"), ("b", 5, "y"), ("c", 1, "z")], "key string, version long, body string")
    assert sorted(r.key for r in target.pending(source).collect()) == ["b", "c"] and target.rows().count() == 0
    target.run(source, lambda pending: pending)
    assert sorted((r.key, r.body) for r in target.rows().collect()) == [("b", "y"), ("c", "z")] and target.pending(source).count() == 0
    with pytest.raises(ValueError):
        target.adopt(source)
