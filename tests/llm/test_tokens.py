import pytest
from tokenizers import Tokenizer

from strataform.llm import tokens

TEXTS = [None, "", " ", "Hello world", "Hello  world \n\n x", "it's they'LL 12345 ...!?", "naïve 日本語のテキスト😀🚀", "a\u00a0b\u3000c\u2003 d", "\t\r\n", "<|endoftext|> is text", "x" * 3000, "é" * 500, "Hello world", "\x00\x1c\x1f control", "\ufeffbom", "   leading", "trailing   "]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "w", [i]) for i, t in enumerate(TEXTS)], "doc_id long, text string, word string, ids array<int>")


def test_same_as_the_tokenizer(spark, docs):
    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/{tokens.BYTE_BPE}.json")
    t.encode_special_tokens = True
    got = {r.doc_id: list(r.ids) for r in tokens.encode(docs, block_chars=500).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    counts = {r.doc_id: r.tokens for r in tokens.count_tokens(docs).collect()}
    assert counts == {i: len(v) for i, v in got.items()}


def test_round_trip(spark, docs):
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(docs)).collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS)}


def test_repeated_and_null_ids_are_decoded_apart(spark):
    rows = spark.createDataFrame([(1, "budget sheet"), (1, "budget sheet"), (None, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in tokens.decode(tokens.encode(rows)).collect())
    assert got == [(0, "a b"), (0, "c"), (1, "budget sheet"), (1, "budget sheet"), (2, "")]


def test_empty_and_repeated(spark, docs):
    assert tokens.encode(docs.limit(0)).count() == 0
    assert tokens.encode(docs.where("doc_id = 3").union(docs.where("doc_id = 3"))).count() == 2
