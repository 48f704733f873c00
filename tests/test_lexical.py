import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataform.operators import lexical

DOCS = [("d1:0", "Costs and revenue by quarter", "Q3 Budget 2025.xlsx", ["Finance"]), ("d2:0", "The budget came up in passing here", "Team notes", ["Weekly"]), ("d2:1", "Please send the invoice to the desk", "Team notes", ["Payments"]), ("d3:0", "A plan for the migration", "Migration", None)]


@pytest.fixture(scope="module")
def index(spark):
    chunks = spark.createDataFrame([(i, t, n, c) for i, t, n, c in DOCS], "chunk_id string, text string, doc_name string, breadcrumbs array<string>")
    docs = lexical.lexical_documents(chunks)
    return lexical.build(docs)


def find(spark, index, text, k=10):
    q = spark.createDataFrame([(1, text)], "query_id int, text string")
    return [r.id for r in lexical.search(q, index, k).orderBy("rank").collect()]


def test_contract(spark, index):
    assert find(spark, index, "Q3 Budget 2025.xlsx")[0] == "d1:0"
    assert find(spark, index, "budget")[:2] == ["d1:0", "d2:0"]
    assert find(spark, index, "migraton")[0] == "d3:0"
    assert find(spark, index, "invoic")[0] == "d2:1"
    assert find(spark, index, "  ") == [] == find(spark, index, "") == find(spark, index, "zzzzzz")
    assert len(find(spark, index, "the budget plan invoice", 2)) == 2
    assert lexical.vocabulary_size(index.postings).first().chunks == 4


def test_an_index_for_stated_queries_answers_as_the_whole(spark):
    rows = [("a", "Budgets, budget; BUDGET plans", "Störung 2025", "é"), ("b", None, "The plan", None), ("c", "", "planner's budgetary überplan", "plan"), ("d", "de desk design", "d 障害報告", ""), ("d", "desk again too", "x y", None)]
    docs = spark.createDataFrame(rows, "chunk_id string, text string, title string, breadcrumbs string")
    q = spark.createDataFrame([(1, "budget plan"), (2, "d’or"), (3, "STÖR 障害"), (4, "de de"), (5, " "), (6, "zzz"), (7, "planner")], "query_id int, text string")
    begins = lexical.first_words(q)
    assert begins == ["budget", "d", "or", "plan", "stör", "zzz", "障害"]  # design begins with d
    whole, some = lexical.build(docs), lexical.build_for(docs, begins)
    found = lambda index: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in lexical.search(q, index, 10, lexical.Scoring(fuzzy=0.0)).collect())
    assert found(some) == found(whole) != []
    kept = lambda df: sorted((r.term, r.field, r.chunk_id, r.tf) for r in df.collect() if r.term.startswith(tuple(begins)))
    assert kept(some.postings) == kept(whole.postings) and some.postings.count() == len(kept(some.postings)) < whole.postings.count()
    assert sorted(map(tuple, some.statistics.collect())) == sorted(map(tuple, whole.statistics.collect()))


def test_words_beyond_a_limit_are_not_named(spark, monkeypatch):
    monkeypatch.setattr(lexical, "NAMED_TERMS", 2)
    assert lexical.first_words(spark.createDataFrame([("a b a",)], "text string")) == ["a", "b"]
    assert lexical.first_words(spark.createDataFrame([("a b c",)], "text string")) is None


def test_remove_and_add_again(spark, index):
    ids = spark.createDataFrame([("d1:0",), ("none",)], "chunk_id string")
    assert find(spark, lexical.without(index, ids, index.statistics), "budget") == ["d2:0"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=9), min_size=1, max_size=25), st.lists(st.text(alphabet="abc", min_size=1, max_size=9), min_size=1, max_size=6))
def test_expansions_equal_brute_force(spark, words, asked):
    vocabulary = spark.createDataFrame([(w,) for w in set(words)], "term string")
    terms = spark.createDataFrame([(1, q) for q in set(asked)], "query_id int, q string")
    got = {(r.q, r.term) for r in lexical.expansions(terms, vocabulary).collect()}
    want = {(q, w) for q in set(asked) for w in set(words) if w.startswith(q) or distance(q, w) <= int(0.2 * len(q) + 0.5)}
    assert got == want
