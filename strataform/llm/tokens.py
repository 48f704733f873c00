"""Token ids of a whole corpus, each distinct word encoded once.

A byte-level pair encoding works word by word, where the words are what the
vocabulary's split pattern cuts a text into.  So the corpus is split in Spark,
the distinct words are encoded once each, and the ids are joined back by
position:

* documents are hashed into blocks of a few megabytes; the words of a block
  are made distinct before they are shuffled, so a frequent word costs one row
  a block and never a hot key;
* the distinct words of all blocks are encoded, once each;
* the ids return to the blocks, and each block replaces its words by lookup.

Decoding joins the ids with the table of pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.workspace import spread, staged

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k"
#: Fixed value: the split pattern of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Java's \s is that of ASCII unless told otherwise.
SPARK_SPLIT = "(?U)" + SPLIT
BLOCK_CHARS = 4_000_000


def _tokenizer(name: str, folder: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(Path(folder) / f"{name}.json"))
    t.encode_special_tokens = True
    return t


def word_ids(name: str = BYTE_BPE, folder: str = TOKENIZERS):
    """Arrow mapper: a column of words to words and their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(name, folder)
        for batch in batches:
            words = batch.column(0)
            ids = [e.ids for e in tokenizer.encode_batch(words.to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([words, pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


WORD_IDS = T.StructType([T.StructField("word", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
DOC_IDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
DOC_COUNTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tokens", T.LongType())])


def _replace(docs: pa.Table, words: pa.Table) -> pa.Table:
    """Ids of the documents of a block, by lookup of their words."""
    texts = docs.column("words").combine_chunks()
    flat = texts.flatten()
    at = pc.index_in(flat, value_set=words.column("word").combine_chunks())
    if at.null_count:
        raise ValueError("a word of the block has no ids")
    at = at.to_numpy()
    lists = words.column("ids").combine_chunks()
    starts = lists.offsets.to_numpy()
    pool = lists.values.to_numpy(zero_copy_only=False)
    length = starts[1:] - starts[:-1]
    n = length[at].astype(np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    # position of each output id in the pool: its word's start plus its place in the word
    out = pool[np.repeat(starts[at] - (ends - n), n) + np.arange(total)] if total else np.zeros(0, np.int32)
    word_ends = texts.offsets.to_numpy() - texts.offsets.to_numpy()[0]
    offsets = np.r_[0, ends][word_ends]
    ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out.astype(np.int32)))
    return pa.table({"doc_id": docs.column("doc_id"), "ids": ids})


def _counted(docs: pa.Table, words: pa.Table) -> pa.Table:
    encoded = _replace(docs, words)
    return pa.table({"doc_id": encoded["doc_id"], "tokens": pc.cast(pc.list_value_length(encoded["ids"]), pa.int64())})


def _block_mapper(fn, fields: dict):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        if docs.num_rows == 0:
            return pa.schema(fields).empty_table()
        return fn(docs, words)

    return run


def _blocked(documents: DataFrame, block_chars: int) -> DataFrame:
    """``doc_id, block, words``: the documents' words, hashed into blocks."""
    size = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"),
        F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.regexp_extract_all("text", F.lit(SPARK_SPLIT), F.lit(0))).alias("words"),
    )


def _encode(documents: DataFrame, name: str, folder: str, block_chars: int, fn, schema: T.StructType, fields: dict) -> DataFrame:
    docs = staged(_blocked(spread(documents.select("doc_id", "text")), block_chars), "token-words")
    local = docs.select("block", F.explode("words").alias("word")).distinct()
    local = staged(local, "token-block-words")
    table = local.select("word").distinct().mapInArrow(word_ids(name, folder), WORD_IDS)
    back = local.join(table, "word").select("block", "word", "ids")
    return docs.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_block_mapper(fn, fields), schema)


def encode(documents: DataFrame, name: str = BYTE_BPE, folder: str = TOKENIZERS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, ids`` of each document's whole text, without special tokens.

    Empty and null texts give an empty list, blank ones the ids of their
    blanks.  A document listed twice comes out twice; a null doc_id is kept.
    """
    return _encode(documents, name, folder, block_chars, _replace, DOC_IDS, {"doc_id": pa.int64(), "ids": pa.list_(pa.int32())})


def count_tokens(documents: DataFrame, name: str = BYTE_BPE, folder: str = TOKENIZERS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, tokens``: as :func:`encode`, but only the number of ids."""
    return _encode(documents, name, folder, block_chars, _counted, DOC_COUNTS, {"doc_id": pa.int64(), "tokens": pa.int64()})


def pieces(spark: SparkSession, name: str = BYTE_BPE, folder: str = TOKENIZERS) -> DataFrame:
    """``id, piece``: the bytes of every id, from the vocabulary's rank file."""
    lines = spark.read.text(f"file://{Path(folder).resolve()}/{name}.tiktoken")
    part = F.split("value", " ")
    return lines.select(part[1].cast("int").alias("id"), F.unbase64(part[0]).alias("piece"))


def piece_list(name: str = BYTE_BPE, folder: str = TOKENIZERS) -> list[bytes]:
    """The same table as a list, for programs of one process."""
    rows = [line.split() for line in (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines() if line]
    out = [b""] * (max(int(r) for _, r in rows) + 1)
    for word, rank in rows:
        out[int(rank)] = base64.b64decode(word)
    return out


def decode(encoded: DataFrame, name: str = BYTE_BPE, folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``, a row for each; an empty or null list gives an empty text.

    The piece table has one row a vocabulary entry (50,256), which bounds the
    broadcast; bytes are put together before they are read as UTF-8, since a
    character may be spread over several ids.
    """
    table = pieces(encoded.sparkSession, name, folder).select("id", F.hex("piece").alias("piece"))
    # rows are told apart by number, not by doc_id, which may be null or repeated; written once, as the numbers hold for one run only
    numbered = staged(encoded.select(F.monotonically_increasing_id().alias("row"), "doc_id", "ids"), "token-rows")
    rows = numbered.select("row", "doc_id", F.posexplode_outer("ids").alias("at", "id"))
    joined = rows.join(F.broadcast(table), "id", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "piece"))))
    text = F.decode(F.unhex(F.array_join(F.transform(ordered, lambda x: x["piece"]), "")), "UTF-8")
    return joined.groupBy("row").agg(F.first("doc_id").alias("doc_id"), text.alias("text")).drop("row")
