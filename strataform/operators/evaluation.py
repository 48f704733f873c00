"""Retrieval metrics over tables of rankings and of relevant documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.numbers import mean_or_zero


def recall_at(ranked: Column, relevant: Column, k: int) -> Column:
    """Part of the relevant ids among the first k; 0 without relevant ids."""
    n = F.size(relevant)
    return F.when(n > 0, F.size(F.array_intersect(F.slice(ranked, 1, k), relevant)) / n).otherwise(0.0)


def reciprocal_rank(ranked: Column, relevant: Column) -> Column:
    """1 over the place of the first relevant id; 0 if there is none."""
    hit = F.array_position(F.transform(ranked, lambda x: F.array_contains(relevant, x)), F.lit(True))
    return F.when(hit > 0, 1.0 / hit).otherwise(0.0)


def per_query(rankings: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Metrics of each mode and query from ``mode, query_id, doc_id, rank`` and ``query_id, doc_id``.

    Joins and sums only, so that neither a ranking nor a set of relevant ids
    is collected.  A query without relevant ids, or of which a mode found
    nothing, scores 0.
    """
    truth = relevant.select("query_id", "doc_id").distinct()
    sizes = truth.groupBy("query_id").agg(F.count("*").alias("n"))
    modes = rankings.select("mode", "query_id").distinct()
    hits = rankings.join(truth, ["query_id", "doc_id"]).groupBy("mode", "query_id").agg(
        *[F.countDistinct(F.when(F.col("rank") <= k, F.col("doc_id"))).alias(f"hits_{k}") for k in ks], F.min("rank").alias("first")
    )
    rows = modes.join(sizes, "query_id", "left").join(hits, ["mode", "query_id"], "left")
    share = [F.coalesce(F.col(f"hits_{k}") / F.col("n"), F.lit(0.0)).alias(f"recall_at_{k}") for k in ks]
    return rows.select("mode", "query_id", *share, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def summary(rankings: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """``mode, recall_at_k ..., mrr``: means over the queries of each mode."""
    scored = per_query(rankings, relevant, ks)
    return scored.groupBy("mode").agg(*[mean_or_zero(f"recall_at_{k}").alias(f"recall_at_{k}") for k in ks], mean_or_zero("rr").alias("mrr"))


def verdict(scores: DataFrame, mode: str = "hybrid") -> DataFrame:
    """One row: whether a mode is at least as good as every other in all metrics."""
    metrics = [c for c in scores.columns if c != "mode"]
    own = [F.max(F.when(F.col("mode") == mode, F.col(c))) for c in metrics]
    other = [F.coalesce(F.max(F.when(F.col("mode") != mode, F.col(c))), F.lit(0.0)) for c in metrics]
    ok = F.lit(True)
    for a, b in zip(own, other):
        ok = ok & (a >= b - 1e-9)
    return scores.agg(ok.alias("best"))


def overlap(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """``recall``: mean part of the first k hits (``query_id, id, rank``) that a second search finds too."""
    a, b = first.where(F.col("rank") <= k), second.where(F.col("rank") <= k)
    both = a.join(b.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return both.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("r")).agg(mean_or_zero("r").alias("recall"))
