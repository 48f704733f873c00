"""Remote services, checks of stored data, and rules for clusters."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform import workspace
from strataform.functions import hashing
from strataform.operators import batching, embedding, exporting
from strataform.operators.embedding import Embedder, EmbeddingSpace
from strataform.sources.snapshots import SnapshotStore

SPACE = EmbeddingSpace("m", "1", 2)


def answers(errors):
    left = list(errors)

    def call():
        if left:
            raise left.pop(0)
        return "ok"

    return call


def test_the_servers_delay_goes_first():
    waits = []
    assert exporting.with_retries(answers([exporting.Refused(429, "", 7.5), exporting.Refused(503, "", 0.25)]), sleep=waits.append) == "ok"
    assert waits == [7.5, 0.25]
    waits.clear()
    exporting.with_retries(answers([exporting.Refused(500), ConnectionError()]), sleep=waits.append)
    assert 0.5 <= waits[0] <= 1 and 1 <= waits[1] <= 2
    with pytest.raises(exporting.Refused):
        exporting.with_retries(answers([exporting.Refused(403, "forbidden")]), sleep=waits.append)
    with pytest.raises(exporting.Refused):
        exporting.with_retries(answers([exporting.Refused(429)] * 5), sleep=lambda s: None)


def test_the_exporter_tries_again(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")

    def fetch(doc_id, asked=Counter()):
        asked[doc_id] += 1
        if doc_id == "b" and asked["b"] < 3:
            raise exporting.Refused(403, "quotaExceeded", 0.0)
        if doc_id == "c":
            raise exporting.Refused(404, "gone")
        return f"{doc_id} after {asked[doc_id]}"

    rows = {r.doc_id: (r.markdown, r.error) for r in exporting.export_documents(docs, fetch, pool=1).collect()}
    assert rows == {"a": ("a after 1", None), "b": ("b after 3", None), "c": (None, "Refused: 404 gone")}


def test_remote_embedding_in_slices(spark):
    sizes, waits = [], []

    def call(texts):
        if len(sizes) == 1 and not waits:
            raise exporting.Refused(429, "", 3.0)
        sizes.append(len(texts))
        return {"vectors": [[float(len(t)), 1.0] for t in texts], "dims": 2, "model": "m"}

    got = Embedder(SPACE, embedding.remote(SPACE, call, sleep=waits.append)).embed_list(["x" * i for i in range(30)])
    assert sizes == [12, 12, 6] and waits == [3.0] and got[:, 0].tolist() == list(range(30))


@pytest.mark.parametrize("answer, fault", [(None, "malformed"), ({"vectors": [[1, 2]], "dims": 2}, "malformed"), ({"vectors": [[1, 2]], "dims": 2, "model": "x"}, "model"), ({"vectors": [[1, 2]], "dims": 3, "model": "m"}, "dims"), ({"vectors": [], "dims": 2, "model": "m"}, "count"), ({"vectors": [[1]], "dims": 2, "model": "m"}, "vector length")])
def test_bad_answers(answer, fault):
    with pytest.raises(ValueError, match=fault):
        embedding.remote(SPACE, lambda texts: answer)(["a"])


def test_spaces():
    assert embedding.space_for("hashed-ngrams") == embedding.HASHED
    with pytest.raises(ValueError):
        embedding.space_for("other")


def test_checksums_of_many():
    rng = np.random.default_rng(0)
    values = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 0, 1, 2, 2, 7, 50, 50, 51, 900, 5000)]
    assert hashing.fnv1a_many(values).tolist() == [hashing.fnv1a(v) for v in values]


def test_sparse_ids_give_few_buckets(spark):
    texts = spark.createDataFrame([(i * 10**9 + i % 7, "x" * (i % 3)) for i in range(500)], "idx long, text string")
    got = {(r.idx, r.batch_id, r.pos) for r in batching.plan_batches(texts, batching.BatchOptions(7, 10), bucket_rows=20).collect()}
    want = batching.plan_list([i % 3 for i in range(500)], batching.BatchOptions(7, 10))
    assert got == {(i * 10**9 + i % 7, b, p) for b, part in enumerate(want) for p, i in enumerate(part)}


def test_damaged_data_is_told(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", SPACE)
    index = spark.createDataFrame([(f"c{i}", "d", "t", None, [1.0, float(i)]) for i in range(20)], "chunk_id string, doc_id string, text string, modified_time string, embedding array<float>")
    store.save(index)
    assert store.load(verify=True).loaded
    part = next((tmp_path / "s").rglob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-40])
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    found = store.load(verify=True)
    assert not found.loaded and found.reason.startswith("damaged data")


def test_a_cluster_must_name_its_shared_folder():
    def session(master):
        context = SimpleNamespace(master=master, getConf=lambda: {}, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d))

    assert workspace.shared_dir(session("local[2]")).startswith("file:///")
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            workspace.shared_dir(session(master))


def test_rules_of_titles_are_the_same_in_both_engines(spark):
    from strataform.functions import text
    from strataform.operators import chunking

    titles = ["**Bold** [link](u) ##", "a\u00a0# ", " `x` ", "", "# #", "a_b [c](d)(e) ###\u3000"]
    texts = ["One. Two!\u00a0Three?\u3000Four.Five", "", "A.\n\nB", "x. ", "…"]
    df = spark.createDataFrame([(t,) for t in titles], "t string").select(text.clean_inline(F.col("t")).alias("c"))
    assert [r.c for r in df.collect()] == [chunking.plain_title(t) for t in titles]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(text.sentences(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == [chunking.split_sentences(t) for t in texts]
