import math

import numpy as np
import pytest

from strataform.llm import rankwalk

LISTS = [("v", "high"), ("d", "low")]


def frames(spark, hits):
    return spark.createDataFrame(hits, "query_id int, list_id string, id string, score double, mass int"), spark.createDataFrame(LISTS, "list_id string, better string")


def brute(lists, items, lazy, damping=rankwalk.DAMPING):
    """The transition matrix, written out."""
    m = np.zeros((items, items))
    for index, key in lists:
        place = np.full(items, math.inf)
        place[index] = key
        for i in range(items):
            higher = [j for j in range(items) if place[j] < place[i]]
            if lazy:
                m[i, higher] += 1 / items
                m[i, i] += 1 - len(higher) / items
            elif higher:
                m[i, higher] += 1 / len(higher)
            else:
                m[i, i] += 1
    m = damping * m / len(lists) + (1 - damping) / items
    p = np.full(items, 1 / items)
    for _ in range(300):
        p = p @ m
    return p


@pytest.mark.parametrize("lazy", [True, False])
def test_walk_equals_the_matrix(lazy):
    rng = np.random.default_rng(3)
    entries, numbers, keys, queries, want = [], [], [], [], []
    for q in range(20):
        n = int(rng.integers(2, 12))
        lists = []
        for _ in range(int(rng.integers(1, 4))):
            index = rng.choice(n, int(rng.integers(1, n + 1)), replace=False)
            lists.append((index, rng.integers(0, 5, len(index)).astype(float)))
        held = np.unique(np.concatenate([i for i, _ in lists]))  # an item is in some list
        lists = [(np.searchsorted(held, i), k) for i, k in lists]
        for index, key in lists:
            entries += (index + len(queries)).tolist()
            numbers += [max(numbers, default=-1) + 1] * len(index)
            keys += key.tolist()
        queries += [q] * len(held)
        want.append(brute(lists, len(held), lazy))
    got = rankwalk.walk(np.array(entries), np.array(numbers), np.array(keys), np.array(queries), lazy=lazy)
    assert np.allclose(got, np.concatenate(want), atol=1e-9)


def test_the_bound_of_steps_suffices():
    steps = rankwalk.steps_for(0.85, 1e-10)
    assert 2 * 0.85**steps < 1e-10 <= 2 * 0.85 ** (steps - 1)


def test_range_of_scores_does_not_matter(spark):
    hits = [(1, "v", x, s, 0) for x, s in zip("abcd", (4.0, 3.0, 2.0, 1.0))] + [(1, "d", x, s, 0) for x, s in zip("abcd", (1e9, 2e9, 3e300, math.inf))]
    h, l = frames(spark, hits)
    order = [r.id for r in rankwalk.best(rankwalk.rank_walk(h, l), 3).orderBy("place").collect()]
    assert order == ["a", "b", "c"]


def test_dirty_rows(spark):
    hits = [(1, "v", "a", 3.0, 0), (1, "v", "a", 3.0, 0), (1, "v", "b", None, 0), (1, "v", "c", math.nan, 0), (1, "v", None, 9.0, 0), (None, "v", "z", 9.0, 0), (1, "x", "d", 1.0, 0), (2, "d", "e", 5.0, 0)]
    h, l = frames(spark, hits)
    got = {(r.query_id, r.id) for r in rankwalk.rank_walk(h, l).collect()}
    assert got == {(1, "a"), (1, "d"), (2, "e")}
    assert rankwalk.rank_walk(h.limit(0), l).count() == 0


def test_ties_share_mass(spark):
    h, l = frames(spark, [(1, "v", x, 1.0, 0) for x in "abc"])
    masses = [r.mass for r in rankwalk.rank_walk(h, l).collect()]
    assert masses == pytest.approx([1 / 3] * 3)
    assert [r.id for r in rankwalk.best(rankwalk.rank_walk(h, l), 2).orderBy("place").collect()] == ["a", "b"]


@pytest.mark.parametrize("lazy", [True, False])
def test_blocks_give_the_same(spark, lazy):
    rng = np.random.default_rng(5)
    hits = [(q, n, f"i{i}", float(rng.integers(0, 9)), 0) for q in (1, 2) for n in ("v", "d") for i in rng.choice(20, 14, replace=False)]
    hits = [x for x in hits if x[0] == 1]  # of a single query both ways do the same steps
    h, l = frames(spark, hits)
    small = {(r.query_id, r.id): r.mass for r in rankwalk.rank_walk(h, l, tolerance=0.02, lazy=lazy).collect()}
    large = {(r.query_id, r.id): r.mass for r in rankwalk.rank_walk(h, l, tolerance=0.02, lazy=lazy, group_rows=27, block_rows=4).collect()}
    assert small.keys() == large.keys()
    assert all(small[k] == pytest.approx(large[k], abs=1e-12) for k in small)


def test_queries_reach_over_chunks():
    rng = np.random.default_rng(9)
    rows = [(q, n, f"i{i}", float(rng.integers(0, 9))) for q in range(12) for n in ("v", "d") for i in rng.choice(20, 14, replace=False)]
    import pyarrow as pa

    table = pa.table(dict(zip(("query_id", "list_id", "id", "key"), map(list, zip(*rows)))))
    one = pa.Table.from_batches(rankwalk._walk_queries(0.85, 1e-10, True)(table.to_batches()))
    cut = pa.Table.from_batches(rankwalk._walk_queries(0.85, 1e-10, True, chunk_rows=50)(table.to_batches(max_chunksize=17)))
    assert sorted(zip(*one.to_pydict().values())) == sorted(zip(*cut.to_pydict().values()))
