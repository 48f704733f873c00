import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.llm import mixing


def docs(spark, n=600):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        source = ["big", "mid", "tiny", "other", None, " "][rng.choice(6, p=[0.5, 0.3, 0.05, 0.1, 0.03, 0.02])]
        rows.append((i, f"text {i} " + " ".join(f"w{rng.integers(0, 50)}" for _ in range(rng.integers(5, 60))), source, 1))
    rows += [(n, rows[0][1], "tiny", 1), (n + 1, None, "big", 1), (n + 2, " ", "big", 1), (n + 3, "", None, 1), (n + 3, "", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, domain int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    d = docs(spark)
    m = mixing.mix(d, targets(spark, [("big", 0.4, 1), ("mid", 0.4, 2), ("tiny", 0.2, 4)]))
    shares = {r.source: r for r in m.shares.collect()}
    for s, want in (("big", 0.4), ("mid", 0.4), ("tiny", 0.2)):
        assert shares[s].reached_share == pytest.approx(want, abs=0.02)
    assert shares["big"].most_copies <= 1 and shares["mid"].most_copies <= 2 and shares["tiny"].most_copies <= 4
    drawn = m.drawn.toPandas()
    text = {r.doc_id: r.text for r in d.collect()}
    assert drawn.doc_id.map(text).is_unique
    assert drawn.doc_id.map(lambda i: bool(text[i].strip())).all()
    assert drawn.tokens.mul(drawn.copies).sum() == sum(r.drawn_tokens for r in shares.values())


def test_many_memberships_give_the_same(spark, monkeypatch):
    goal = [("big", 0.4, 1), ("mid", 0.4, 2), ("tiny", 0.2, 4)]
    driver = {r.source: r.drawn_tokens for r in mixing.mix(docs(spark), targets(spark, goal)).shares.collect()}
    monkeypatch.setattr(mixing, "FEW_MEMBERSHIPS", 0)
    assert {r.source: r.drawn_tokens for r in mixing.mix(docs(spark), targets(spark, goal)).shares.collect()} == driver


def test_several_texts_of_an_id(spark):
    rows = [(1, "one text of it", "big"), (1, "another text of the same id", "big"), (1, "one text of it", "big"), (2, "a third text", "mid"), (None, "of no id at all", "mid")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn = mixing.mix(d, targets(spark, [("big", 0.5, 5), ("mid", 0.5, 5)])).drawn
    assert sorted(r.doc_id or 0 for r in drawn.collect()) == [0, 1, 1, 2]


def test_soft_members_take_part_where_labels_tell(spark):
    """Texts without a source are drawn by their posterior if the classifier is sure."""
    words = {"a": "river stone field hill", "b": "index query table join"}
    rows = [(i, f"{words['ab'[i % 2]]} {words['ab'[i % 2]]} n{i}", "ab"[i % 2] if i < 300 else None) for i in range(400)]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)]), sure=0.5)
    drawn = m.drawn.collect()
    assert m.accuracy > 0.95 and sum(r.source is None for r in drawn) > 80
    assert all(r.domain == "ab"[r.doc_id % 2] for r in drawn)


def test_unsure_texts_take_part_by_membership(spark):
    """Texts that tell nothing of their source are drawn too, count for each domain by its posterior and leave the shares as they are."""
    goal = [("big", 0.4, 1), ("mid", 0.3, 2), ("nowhere", 0.1, 5), ("tiny", 0.2, 4)]
    d = docs(spark, 900).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("source")))
    m = mixing.mix(d, targets(spark, goal))
    drawn, shares = m.drawn.toPandas(), {r.source: r for r in m.shares.collect()}
    unnamed = drawn.source.isna().to_numpy()
    assert unnamed.sum() > 100
    p, n = np.array(drawn.membership.tolist()), (drawn.tokens * drawn.copies).to_numpy()
    assert p[unnamed].max() < 0.9
    assert np.allclose(p.sum(axis=1), 1) and (p[:, 2] == 0).all() and shares["nowhere"].drawn_tokens == 0
    assert (drawn.copies <= drawn.domain.map({s: c for s, _, c in goal})).all()
    assert sum(r.drawn_tokens for r in shares.values()) == n.sum()
    assert np.abs(n @ p - [shares[s].drawn_tokens for s, _, _ in goal]).max() <= 1
    for s, want, _ in goal:
        assert s == "nowhere" or shares[s].reached_share == pytest.approx(want / 0.9, abs=0.02)


def test_unreachable_and_missing(spark):
    m = mixing.mix(docs(spark), targets(spark, [("big", 0.5, 1), ("nowhere", 0.2, 5), ("tiny", 0.3, 1), (None, 0.1, 1), ("mid", None, 1)]), total_tokens=6000)
    shares = {r.source: r for r in m.shares.collect()}
    assert set(shares) == {"big", "nowhere", "tiny"}
    assert shares["nowhere"].reached_share == 0 and shares["tiny"].most_copies == 1
    assert shares["big"].drawn_tokens == pytest.approx(3000, rel=0.05)


def test_empty(spark):
    d = docs(spark)
    assert mixing.mix(d.limit(0), targets(spark, [("big", 1.0, 1)])).drawn.count() == 0
    assert mixing.mix(d, targets(spark, [])).drawn.count() == 0


def test_classifier_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    words = [["river", "stone", "field"], ["index", "query", "table"]]
    texts = [" ".join(rng.choice(words[i % 2] + ["the", "of", "a"], 12)) for i in range(400)]
    x, y = mixing.featurise(texts), np.arange(400) % 2
    model = mixing.train(x, y, 2)
    assert model.accuracy > 0.95
    noise = mixing.train(x, rng.integers(0, 2, 400), 2)
    assert mixing.posterior(noise, x).max(axis=1).mean() < 0.9


def test_classifier_leaves_out_domains_without_rows():
    rng = np.random.default_rng(2)
    x = mixing.featurise([" ".join(rng.choice(["the", "of", "river", "table"], 12)) for _ in range(60)])
    p = mixing.posterior(mixing.train(x, np.arange(60) % 2 * 2, 3), x)
    assert (p[:, 1] == 0).all() and np.allclose(p.sum(axis=1), 1)


def test_rates_stay_in_bounds():
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    caps = np.array([1.0, 3.0])
    r = mixing.rates(p, caps, [np.array([5.0, 5.0]), np.array([-9.0, 0.1])])
    assert (r >= 0).all() and (r <= p @ caps).all()
