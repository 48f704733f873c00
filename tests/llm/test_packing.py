from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataform.llm.packing import _Complements, _cut, pack, plan


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_uses_every_item_once(lengths):
    counts = Counter(lengths)
    bins = plan(dict(counts), 40)
    used = Counter()
    for b in bins:
        assert sum(length * n for length, n in b.content.items()) + b.room == 40
        assert b.room >= 0 and b.count > 0
        for length, n in b.content.items():
            used[length] += n * b.count
    assert used == counts
    if lengths:
        assert sum(b.count for b in bins) <= 2 * -(-sum(lengths) // 40)


def test_exact_complements_leave_nothing():
    bins = plan({30: 5, 10: 5, 25: 4, 9: 4, 6: 4}, 40)
    assert sum(b.count for b in bins) == 9 and all(b.room == 0 for b in bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(2, 60), st.lists(st.integers(1, 60), max_size=3))
def test_complements_equal_brute_force(lengths, gap, used):
    """A combination is found exactly if there is one, and only from what is left."""
    counts = np.zeros(61, np.int64)
    for x in lengths:
        counts[x] += 1
    taken = {x: n for x, n in Counter(used).items() if counts[x] >= n}
    left = Counter({x: int(counts[x]) - taken.get(x, 0) for x in range(1, 61) if counts[x] > taken.get(x, 0)})
    items = sorted(left.elements())
    there = any(sum(c) == gap for n in (1, 2, 3) for c in combinations(items, n))
    got = _Complements(counts).find(gap, taken)
    assert (got is not None) == there
    assert not got or (sum(got) == gap and not Counter(got) - left)


def test_complements_follow_falling_counts():
    counts = np.zeros(41, np.int64)
    counts[[10, 30, 25, 15]] = 1, 1, 2, 2
    index = _Complements(counts)
    assert index.find(40, {}) == (30, 10)
    counts[30] = 0
    assert index.find(40, {}) == (25, 15)
    counts[15] = 0
    index.drop_empty()
    assert index.find(40, {}) is None


def test_pieces_do_not_carry_the_text():
    text = "word " * 200_000
    batch = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([text])], names=["text_hash", "text"])
    out = list(_cut(4000)(iter([batch])))
    assert sum(b.nbytes for b in out) < 1.2 * len(text) and "".join(x for b in out for x in b.column(3).to_pylist()) == text


def test_many_items_fill_well():
    rng = np.random.default_rng(1)
    lengths = np.minimum(1300, rng.gamma(2, 250, 20000).astype(int) + 1)
    bins = plan(dict(Counter(lengths.tolist())), 4000)
    n = sum(b.count for b in bins)
    assert n <= 1.002 * lengths.sum() / 4000 + 1


def test_rows(spark):
    texts = [None, "", " \u3000", "a" * 30, "a" * 30, "b" * 10, "c" * 40, "word " * 30, "x" * 90, "é😀"] + [f"{i:07d}" for i in range(60)]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, batch_id int")
    rows = pack(df, F.col("text"), 40, bucket_rows=7).toPandas()
    assert rows.groupby("batch_id").n_chars.sum().max() <= 40
    assert (rows.text.str.len() == rows.n_chars).all()
    back = rows.sort_values("piece").groupby("text_hash").text.sum()
    assert set(back) == {t for t in texts if t and t.strip()}
    assert set(rows[rows.pieces > 1].text_hash) == set(rows[rows.text_hash.isin(back[back.str.len() > 40].index)].text_hash)
    assert sorted(set(rows.batch_id)) == list(range(rows.batch_id.max() + 1))
    assert pack(df.limit(0), F.col("text"), 40).count() == 0
