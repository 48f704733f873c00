"""Keeping an index of chunks and vectors: diffing, adding, updating, removing.

Two ways to bring chunks in, on purpose: ``add_chunks`` inserts ids that are
absent and never touches others; ``update_documents`` replaces all chunks of the
documents given and reuses the vectors of texts that a document already had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.operators.embedding import Embedder
from strataform.workspace import staged


def diff_chunks(fresh: DataFrame, existing: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """New chunks with the vector of the same text in the same document, or null.

    The join is on a 64-bit hash and then on the text itself.  Of several
    vectors of one text, the one of the greatest chunk id counts.
    """
    on = [*keys, "_hash"]
    old = existing.withColumn("_hash", F.xxhash64("text")).groupBy(*on, F.col("text").alias("_text")).agg(F.max_by("embedding", "chunk_id").alias("embedding"))
    new = fresh.drop("embedding").withColumn("_hash", F.xxhash64("text"))
    match = [new[k].eqNullSafe(old[k]) if k != "_hash" else new[k] == old[k] for k in on] + [new["text"] == old["_text"]]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return new.join(old, condition, "left").select(*[new[c] for c in new.columns if c != "_hash"], old["embedding"])


def reuse_counts(planned: DataFrame) -> DataFrame:
    """``reused, to_embed`` of a diff."""
    return planned.agg(F.count("embedding").alias("reused"), F.sum(F.col("embedding").isNull().cast("int")).alias("to_embed"))


def add_chunks(index: DataFrame, chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """The index with the chunks whose ids it lacks; a second run changes nothing."""
    fresh = chunks.join(index.select("chunk_id"), "chunk_id", "left_anti").dropDuplicates(["chunk_id"])
    if embedder is not None:
        fresh = embedder.embed(fresh.drop("embedding"))
    return index.unionByName(fresh, allowMissingColumns=True)


def remove_documents(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without the chunks of some documents; absent ids change nothing."""
    return index.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*index.columns)


def update_documents(index: DataFrame, chunks: DataFrame, ids: DataFrame, embedder: Embedder) -> DataFrame:
    """The index with all chunks of ``ids`` replaced by those among ``chunks``.

    A document of ``ids`` without chunks is thereby removed.  Only texts the
    document didn't have are embedded.
    """
    touched = index.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    planned = staged(diff_chunks(chunks.drop("embedding"), touched), "diff")  # used twice below
    known = planned.where("embedding is not null")
    fresh = embedder.embed(planned.where("embedding is null").drop("embedding"))
    return remove_documents(index, ids).unionByName(known.unionByName(fresh).select(*index.columns))


def apply_intents(docs: DataFrame, intents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents after the last intents (``key, intent``): removed ones leave, others stay."""
    gone = intents.where("intent = 'remove'").select(key)
    return docs.join(gone, key, "left_anti")


def index_stats(index: DataFrame) -> DataFrame:
    """``index_size, doc_count``, one row, also over an empty index."""
    return index.agg(F.count("*").alias("index_size"), F.countDistinct("doc_id").alias("doc_count"))


def progress(docs: DataFrame, chunks: DataFrame, failures: DataFrame) -> DataFrame:
    """One row on an index in the making: documents in all, done and failed, chunks, status.

    ``docs`` are those to be indexed, ``chunks`` and ``failures`` what there is
    so far; what is missing from both is what a run that resumes has to do.
    """
    done = chunks.groupBy("doc_id").agg(F.count("*").alias("done"))
    failed = failures.select("doc_id").distinct().withColumn("failed", F.lit(1))
    state = docs.select("doc_id").distinct().join(done, "doc_id", "left").join(failed, "doc_id", "left")
    row = state.agg(F.count("*").alias("total_docs"), F.count("done").alias("done_docs"), F.count(F.when(F.col("done").isNull(), F.col("failed"))).alias("failed_docs"), F.coalesce(F.sum("done"), F.lit(0)).alias("done_chunks"))
    left = F.col("total_docs") - F.col("done_docs") - F.col("failed_docs")
    status = F.when(F.col("total_docs") == 0, "idle").when(left > 0, "running").otherwise("done")
    return row.withColumn("status", status)


def unfinished(docs: DataFrame, chunks: DataFrame, failures: DataFrame) -> DataFrame:
    """Documents that a run which resumes still has to index."""
    return docs.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").join(failures.select("doc_id").distinct(), "doc_id", "left_anti")


def remaining_seconds(done_docs, total_docs, done_chunks, elapsed_seconds, running):
    """Estimated seconds left, or null before two seconds, a chunk and a document have passed."""
    rate = done_chunks / elapsed_seconds
    left = F.floor(F.greatest(F.lit(0), done_chunks / done_docs * total_docs - done_chunks) / rate + 0.5)
    return F.when(running & (elapsed_seconds >= 2) & (done_chunks > 0) & (done_docs > 0), left)
