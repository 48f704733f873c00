"""Joining ranked lists into one, and chunks into documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.functions.text import epoch_millis, snippet

RRF_K = 60


def candidate_depth(k: int) -> int:
    """How many hits each ranker contributes to a search for k."""
    return max(5 * k, 50)


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = RRF_K, recency: DataFrame | None = None) -> DataFrame:
    """``query_id, id, score, fused_rank`` from lists of ``query_id, id, rank``.

    The score is the sum of ``1 / (k + rank)``.  Scores that agree to nine
    places tie; the more recent comes first (``recency`` has ``id, recency``; 0
    where absent), then the one that stands higher in the first list that holds
    it, then the smaller id.
    """
    marked = [df.select("query_id", "id", *[(F.col("rank") if i == j else F.lit(None).cast("int")).alias(f"r{j}") for j in range(len(lists))]) for i, df in enumerate(lists)]
    ranks = [f"r{j}" for j in range(len(lists))]
    union = reduce(DataFrame.unionByName, marked)
    score = reduce(lambda a, b: a + b, [F.coalesce(F.sum(F.lit(1.0) / (k + F.col(r))), F.lit(0.0)) for r in ranks])
    fused = union.groupBy("query_id", "id").agg(score.alias("score"), *[F.min(r).alias(r) for r in ranks])
    if recency is not None:
        fused = fused.join(recency.groupBy("id").agg(F.max("recency").alias("recency")), "id", "left")
    else:
        fused = fused.withColumn("recency", F.lit(0))
    fused = fused.withColumn("recency", F.coalesce("recency", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("recency").desc(), *[F.col(r).asc_nulls_last() for r in ranks], "id")
    return fused.withColumn("fused_rank", F.row_number().over(order)).select("query_id", "id", "score", "fused_rank")


def best_chunk_per_document(fused: DataFrame, chunks: DataFrame, k: int | None) -> DataFrame:
    """The first chunk of each document in fused order, at most k documents.

    Hits without a chunk row are left out before documents are counted.
    """
    rows = fused.join(chunks, fused["id"] == chunks["chunk_id"]).drop("id")
    first = Window.partitionBy("query_id", "doc_id").orderBy("fused_rank", "chunk_id")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    place = Window.partitionBy("query_id").orderBy("fused_rank", "chunk_id")
    rows = rows.withColumn("place", F.row_number().over(place))
    return rows if k is None else rows.where(F.col("place") <= k)


def recency_of(chunks: DataFrame) -> DataFrame:
    """``id, recency``: the time of each chunk's document, 0 if unreadable."""
    return chunks.select(F.col("chunk_id").alias("id"), epoch_millis(F.col("modified_time")).alias("recency"))


def document_hits(collapsed: DataFrame) -> DataFrame:
    """The shape in which results are shown."""
    return collapsed.select("query_id", "place", "doc_id", "doc_name", "breadcrumbs", snippet(F.col("text")).alias("snippet"), "score", "chunk_id")


