import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataform.llm import splitting
from strataform.llm.splitting import cut_kinds, split_oversized, split_text

BLANK_OR_MARK = set(".!?。！？")


def longest_run(text):
    best = run = 0
    for c in text:
        run = 0 if c.isspace() or c in BLANK_OR_MARK else run + 1
        best = max(best, run)
    return best


def check(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert all(p.end - p.start <= limit for p in pieces)
    assert "".join(text[p.start + p.overlap : p.end] for p in pieces) == text
    assert all(0 <= p.overlap <= overlap for p in pieces)
    assert pieces[0].overlap == 0
    if len(text) > limit:
        forced = any(p.cut == 0 for p in pieces[:-1])
        assert forced == (longest_run(text) > limit)
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdefg  \n.。!\u00a0\u3000#😀", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_limits_cover_and_force(text, limit, overlap):
    check(text, limit, overlap)


def test_snaps_to_the_strongest_boundary():
    text = "one two three. " * 30 + "\n\n# Heading\n" + "four five six. " * 30
    pieces = check(text, 600, 0)
    assert len(pieces) == 2
    assert text[pieces[1].start :].startswith("# Heading")


def test_pieces_have_like_length_and_repeat_sentences():
    text = " ".join(f"Sentence number {i} says nothing new." for i in range(200))
    pieces = check(text, 1200, 150)
    lengths = [p.end - p.start - p.overlap for p in pieces]
    assert max(lengths) < 1.5 * min(lengths)
    assert all(0 < p.overlap <= 150 for p in pieces[1:])
    # the last piece may repeat less, from a word on, to stay within the limit
    assert all(text[p.start :].startswith("Sentence") for p in pieces[:-1])
    assert text[pieces[-1].start - 1] == " "


def test_run_of_exactly_the_limit_is_natural():
    check("x" * 50 + ".", 50, 5)
    check("x" * 51 + ".", 50, 5)
    check(" " * 200, 50, 5)


def test_bad_limits():
    with pytest.raises(ValueError):
        split_text("x", 5, 5)


def test_rows(spark):
    rows = [("a", "x" * 30, 1), ("a", "x" * 30, 1), ("a", "word " * 8, 2), ("b", "", 3), (None, "y z " * 9, 4), ("c", None, 5), ("d", "short", 6)]
    df = spark.createDataFrame(rows, "id string, text string, piece int")
    pieces = split_oversized(df, F.col("id"), F.col("text"), "doc", 20, 5)
    kinds = {(r.record_id, r.cut) for r in cut_kinds(pieces).collect()}
    assert kinds == {("a", "forced"), (None, "natural")}
    assert pieces.where("record_id = 'a'").select("text_hash").distinct().count() == 2
    assert split_oversized(df.limit(0), F.col("id"), F.col("text"), "doc", 20, 5).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n", min_size=1, max_size=120), st.integers(1, 12), st.integers(0, 11))
def test_pieces_are_added_until_every_limit_holds(text, limit, overlap):
    pieces = splitting.split_text(text, limit, min(overlap, limit - 1))
    assert all(0 < p.end - p.start <= limit for p in pieces)
    assert "".join(text[p.start + p.overlap : p.end] for p in pieces) == text


def test_many_tries():
    """A text whose first hundreds of piece counts all fail: long runs between short words."""
    text = ("a " * 30 + "b" * 97 + " ") * 40
    pieces = splitting.split_text(text, 100, 40)
    assert max(p.end - p.start for p in pieces) <= 100 and "".join(text[p.start + p.overlap : p.end] for p in pieces) == text
    assert not any(p.cut == splitting.HARD for p in pieces[:-1])
