"""Merging two snapshots of an index: for each document, the later one wins whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.text import instant


def winners(a: DataFrame, b: DataFrame, time: Column | None = None) -> DataFrame:
    """``doc_id, side``: which snapshot (0 for a, 1 for b) holds the later version.

    Times are compared as instants; one that is missing or unreadable is the
    earliest.  On a tie a wins.  Both sides are aggregated before they meet.
    """
    when = instant(F.col("modified_time")) if time is None else time
    newest = F.coalesce(F.unix_micros(F.max(when)), F.lit(-(2**62)))
    sides = [s.groupBy("doc_id").agg(newest.alias("at")).withColumn("side", F.lit(n)) for n, s in ((0, a), (1, b))]
    union = sides[0].unionByName(sides[1])
    return union.groupBy("doc_id").agg(F.max_by("side", F.struct("at", -F.col("side"))).alias("side"))


def merge(a: DataFrame, b: DataFrame, time: Column | None = None) -> DataFrame:
    """Chunks of both snapshots; of a document in both, those of the later one only.

    Merging with itself or an empty snapshot changes nothing, and apart from
    ties the order of the two doesn't matter.  There are no tombstones: a
    document that one side has deleted comes back if the other still has it.
    """
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    won = winners(a, b, time).select(F.col("doc_id").alias("w_doc"), F.col("side").alias("w_side"))
    return both.join(won, both["doc_id"].eqNullSafe(won["w_doc"]) & (both["side"] == won["w_side"]), "left_semi").drop("side")
