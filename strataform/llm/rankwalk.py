"""One ranking from several differently scaled scores, by a walk over ranks.

The walker stands on an item of the query.  It picks one of the query's score
lists at random and jumps to one of the items which that list places higher,
all with the same chance; an item the list doesn't hold stands below all it
holds.  With a small chance (damping) it jumps anywhere instead.  Where it is
found most often is the best item.  Only places matter, so no list weighs more
for the range of its scores.  One step needs, in each list, the probability of
all items below a place: a suffix sum over the sorted list.

How it jumps is an option, because two readings give different orders:

* ``lazy=False``: it always jumps if anything is higher.  From low places it
  jumps as often as from high ones, so the head of a single list gathers what
  the whole list holds.
* ``lazy=True`` (default): it proposes any item of the query and jumps there
  if that one is higher, else it stays.  Each higher item still has the same
  chance, but the walker leaves a place the less, the higher it is.

Damping makes each step shrink the distance to the end by ``damping`` at
least, which bounds the steps a tolerance can need (``steps_for``); no walk
ends before it reached the tolerance.  A query's walk ends when its own
probabilities moved by less than the tolerance.

Queries up to ``group_rows`` hits are walked together, many at a time, in one
set of array operations.  Larger ones are cut into blocks of consecutive
places: block totals give each block its offset, so that no task ever holds
more than a block.  Both ways do the same arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strataform.workspace import discard, partitions, staged

DAMPING = 0.85
TOLERANCE = 1e-10
#: Hits that are walked together.
CHUNK_ROWS = 100_000


def steps_for(damping: float, tolerance: float) -> int:
    """Steps after which two distributions that differ by 2 at most differ by less than the tolerance."""
    return max(1, math.ceil(math.log(tolerance / 2) / math.log(damping)))


def usable(hits: DataFrame) -> DataFrame:
    """Hits that count: rows without a score (null, NaN), query, list or id don't."""
    return hits.select("query_id", "list_id", "id", "score").where("query_id is not null and list_id is not null and id is not null and score is not null and not isnan(score)")


def placed(hits: DataFrame, lists: DataFrame) -> DataFrame:
    """Usable hits as ``query_id, list_id, id, key``; a smaller key is better.

    Of several scores of one id in one list the best counts.  A list not named
    in ``lists`` is taken as "high".
    """
    sides = lists.select("list_id", "better").dropDuplicates(["list_id"])
    better = F.coalesce(F.col("better"), F.lit("high"))
    return (
        hits.join(sides, "list_id", "left")
        .groupBy("query_id", "list_id", "id")
        .agg(F.min(F.when(better == "low", F.col("score")).otherwise(-F.col("score"))).alias("key"))
    )


def walk(entries: np.ndarray, lists: np.ndarray, keys: np.ndarray, queries: np.ndarray, damping: float = DAMPING, tolerance: float = TOLERANCE, lazy: bool = True) -> np.ndarray:
    """Stationary probabilities of all items, each query's summing to 1.

    Entry i says that list ``lists[i]`` holds item ``entries[i]`` with key
    ``keys[i]`` (smaller is better); item j belongs to query ``queries[j]``.
    Lists, items and queries are numbered from 0.  Items tied in a list share a
    place and don't jump to each other.
    """
    items, asked = len(queries), int(queries.max(initial=-1)) + 1
    size = np.bincount(queries, minlength=asked)
    order = np.lexsort((keys, lists))
    entries, lists, keys = entries[order], lists[order], keys[order]
    length = np.bincount(lists)
    first = np.cumsum(length) - length
    of_list = queries[entries[first]]  # the query of each list
    several = np.bincount(of_list, minlength=asked)
    fresh = np.r_[True, (lists[1:] != lists[:-1]) | (keys[1:] != keys[:-1])]
    tie = np.cumsum(fresh) - 1
    starts = np.flatnonzero(fresh)
    above = starts[tie] - first[lists]
    end = np.r_[starts[1:], len(lists)][tie] - first[lists]
    n = size[queries[entries]]
    in_lists, held = np.bincount(entries, minlength=items), np.zeros(items)
    np.add.at(held, entries, length[lists])
    total_length = np.bincount(of_list, length, asked)
    if lazy:
        weight, lost = 1.0 / n, 1.0 / size[of_list]  # of an entry, and of an item its list doesn't hold
        stay = np.bincount(entries, (n - above) / n, items)
        missing = several[queries] - in_lists
        stay += missing - (total_length[queries] - held) / size[queries]
    else:
        weight, lost = np.where(above > 0, 1.0 / np.maximum(1, above), 0.0), 1.0 / length
        stay = np.bincount(entries, above == 0, items).astype(float)
    # lists of like length side by side, so that sums run along rows
    groups = []
    kinds = np.ceil(np.log2(np.maximum(1, length))).astype(int)
    row_of = np.empty(len(length), np.int64)
    for kind in np.unique(kinds):
        mine = np.flatnonzero(kinds == kind)
        width = int(length[mine].max())
        row_of[mine] = np.arange(len(mine))
        at = np.flatnonzero(kinds[lists] == kind)
        flat = row_of[lists[at]] * width + at - first[lists[at]]
        index = np.full(len(mine) * width, items, np.int64)
        factor = np.zeros(len(mine) * width)
        index[flat], factor[flat] = entries[at], weight[at]
        groups.append((index.reshape(-1, width), factor.reshape(-1, width), row_of[lists[at]] * (width + 1) + end[at], row_of[lists[at]], entries[at], lost[mine]))
    targets = np.concatenate([g[4] for g in groups]) if groups else np.zeros(0, np.int64)
    teleport, share = (1 - damping) / size[queries], damping / several[queries]
    p = np.r_[1.0 / size[queries], 0.0]
    moving = np.ones(asked, bool)
    for _ in range(steps_for(damping, tolerance)):
        came = []
        for index, factor, after, row, _entries, lost_ in groups:
            mass = p[index]
            tail = np.zeros((len(index), index.shape[1] + 1))
            tail[:, :-1] = np.cumsum((mass * factor)[:, ::-1], axis=1)[:, ::-1]
            absent = np.maximum(0.0, 1.0 - mass.sum(axis=1)) * lost_
            came.append(tail.ravel()[after] + absent[row])
        flow = np.bincount(targets, np.concatenate(came), items) if groups else np.zeros(items)
        new = share * (flow + p[:-1] * stay) + teleport
        moved = np.bincount(queries, np.abs(new - p[:-1]), asked)
        p[:-1] = np.where(moving[queries], new, p[:-1])
        moving &= moved >= tolerance
        if not moving.any():
            break
    return p[:-1]


SCORED = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.StringType()), T.StructField("mass", T.DoubleType())])


def _walk_chunk(rows: pa.Table, damping: float, tolerance: float, lazy: bool) -> pa.RecordBatch:
    q = rows["query_id"].to_numpy()
    ids = rows["id"].combine_chunks().dictionary_encode()
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.chunk(0)
    asked, query = np.unique(q, return_inverse=True)
    names = rows["list_id"].combine_chunks().dictionary_encode()
    _, lists = np.unique(query * np.int64(len(names.dictionary)) + names.indices.to_numpy(), return_inverse=True)
    items, entries = np.unique(query * np.int64(len(ids.dictionary)) + ids.indices.to_numpy(), return_inverse=True)
    of = items // len(ids.dictionary)
    mass = walk(entries, lists, rows["key"].to_numpy(), of, damping, tolerance, lazy)
    return pa.RecordBatch.from_arrays([pa.array(asked[of], pa.int64()), ids.dictionary.take(pa.array(items % len(ids.dictionary))), pa.array(mass)], names=SCORED.names)


def _walk_queries(damping: float, tolerance: float, lazy: bool, chunk_rows: int = CHUNK_ROWS):
    """Arrow mapper over rows sorted by query: whole queries, about ``chunk_rows`` hits at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < chunk_rows:
                continue
            rows = pa.Table.from_batches(held)
            q = rows["query_id"].to_numpy()
            whole = int(np.searchsorted(q, q[-1]))  # the last query may go on
            if whole:
                yield _walk_chunk(rows.slice(0, whole), damping, tolerance, lazy)
                held = rows.slice(whole).to_batches()
                n = len(q) - whole
        if held:
            yield _walk_chunk(pa.Table.from_batches(held), damping, tolerance, lazy)

    return run


def _walk_blocks(rows: DataFrame, block_rows: int, damping: float, tolerance: float, lazy: bool) -> DataFrame:
    """The same walk for queries of any size, block by block."""
    one = ["query_id", "list_id"]
    # Places without a sort of a whole list in one task: rows are ranged by key,
    # and a tie shares one place because equal keys are counted together.
    ties = rows.groupBy(*one, "key").agg(F.count("*").alias("n"))
    ranged = ties.repartitionByRange(*one, "key").sortWithinPartitions(*one, "key").withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "walk-ties")
    inside = Window.partitionBy(*one, "part").orderBy("key")
    parts = ranged.groupBy(*one, "part").agg(F.sum("n").alias("part_n"))
    before = F.coalesce(F.sum("part_n").over(Window.partitionBy(*one).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(*one, "part", before.alias("before"))
    ends = ranged.withColumn("end", F.sum("n").over(inside)).join(offsets, [*one, "part"]).select(*one, "key", (F.col("end") + F.col("before")).alias("reach"), "n")
    entries = (
        rows.join(ends, [*one, "key"])
        # reach: items at this place or above; the block is one of consecutive places
        .select(*one, "id", "reach", (F.col("reach") - F.col("n")).alias("above"), (F.floor((F.col("reach") - 1) / block_rows)).alias("block"))
    )
    lengths = entries.groupBy(*one).agg(F.count("*").alias("length"))
    entries = staged(entries.join(lengths, one), "walk-entries")
    count = entries.select("query_id", "id").distinct().groupBy("query_id").agg(F.count("*").alias("items"))
    lists = lengths.groupBy("query_id").agg(F.count("*").alias("lists"), F.sum("length").alias("lengths"))
    sizes = staged(lists.join(count, "query_id"), "walk-sizes")
    # what an item keeps: its own place in the lists that hold it, the bottom of the others
    own = entries.groupBy("query_id", "id").agg(F.count("*").alias("in_lists"), F.sum("length").alias("in_length"), F.sum("above").alias("above"), F.sum((F.col("above") == 0).cast("int")).alias("heads")).join(sizes, "query_id")
    if lazy:
        stays = F.col("lists") - (F.col("above") + F.col("lengths") - F.col("in_length")) / F.col("items")
        weight, lost = F.lit(1.0) / F.col("items"), F.lit(1.0) / F.col("items")
    else:
        stays = F.col("heads").cast("double")
        weight, lost = F.when(F.col("above") > 0, 1.0 / F.col("above")).otherwise(0.0), F.lit(1.0) / F.col("length")
    items = staged(own.select("query_id", "id", "items", "lists", stays.alias("stays")), "walk-items")
    weighted = staged(entries.join(sizes.select("query_id", "items"), "query_id").select(*one, "id", "block", "reach", weight.alias("weight"), lost.alias("lost")), "walk-weighted")
    mass = items.select("query_id", "id", (1 / F.col("items")).alias("mass"))
    before = None
    for _ in range(steps_for(damping, tolerance)):
        at = weighted.join(mass, ["query_id", "id"]).groupBy(*one, "block", "reach")
        places = staged(at.agg(F.sum(F.col("mass") * F.col("weight")).alias("flow"), F.sum("mass").alias("mass"), F.first("lost").alias("lost")), "walk-places")
        totals = places.groupBy(*one, "block").agg(F.sum("flow").alias("total"), F.sum("mass").alias("mass"))
        later = Window.partitionBy(*one).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
        tails = totals.select(*one, "block", F.coalesce(F.sum("total").over(later), F.lit(0.0)).alias("tail"), F.sum("mass").over(Window.partitionBy(*one)).alias("held"))
        inner = Window.partitionBy(*one, "block").orderBy(F.col("reach").desc())
        arrivals = (F.col("below") - F.col("flow") + F.col("tail") + F.greatest(F.lit(0.0), 1 - F.col("held")) * F.col("lost")).alias("arrivals")
        flows = places.withColumn("below", F.sum("flow").over(inner)).join(tails, [*one, "block"]).select(*one, "block", "reach", arrivals)
        came = weighted.join(flows, [*one, "block", "reach"]).groupBy("query_id", "id").agg(F.sum("arrivals").alias("arrivals"))
        new = came.join(items, ["query_id", "id"]).join(mass, ["query_id", "id"])
        new = new.select("query_id", "id", (damping * (F.col("arrivals") + F.col("mass") * F.col("stays")) / F.col("lists") + (1 - damping) / F.col("items")).alias("new"), "mass")
        new = staged(new, "walk-mass")
        discard(places)
        discard(before)
        # the slowest query decides; one more step changes the others by less than the tolerance
        moved = new.groupBy("query_id").agg(F.sum(F.abs(F.col("new") - F.col("mass"))).alias("moved")).agg(F.max("moved")).first()[0]
        mass, before = new.select("query_id", "id", F.col("new").alias("mass")), new
        if (moved or 0.0) < tolerance:
            break
    return mass.select(F.col("query_id").cast("long").alias("query_id"), "id", "mass")


def rank_walk(
    hits: DataFrame, lists: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, lazy: bool = True, group_rows: int = 200_000, block_rows: int = 50_000
) -> DataFrame:
    """``query_id, id, mass`` of every usable hit's chunk; more mass is better.

    No hits give no rows.  A query with one list keeps its order; ties in all
    lists give equal mass.

    Rows cross the network once, to the task of their query; that shuffle also
    serves the removal of repeated rows.  Only queries over ``group_rows``
    rows, told by a count that is combined before its shuffle, go another way.
    """
    rows = usable(hits)
    counts = staged(rows.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select("query_id"), "walk-large")
    large = counts.count() > 0
    small = rows.join(counts, "query_id", "left_anti") if large else rows
    spark = hits.sparkSession
    tasks = max(partitions(spark), spark.sparkContext.defaultParallelism)
    sorted_ = placed(small.repartition(tasks, "query_id"), lists).select(F.col("query_id").cast("long").alias("query_id"), "list_id", "id", "key").sortWithinPartitions("query_id")
    walked = sorted_.mapInArrow(_walk_queries(damping, tolerance, lazy), SCORED)
    if large:
        walked = walked.unionByName(_walk_blocks(placed(rows.join(counts, "query_id", "left_semi"), lists), block_rows, damping, tolerance, lazy))
    return walked


def best(walked: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query with their place; equal mass in order of id.

    Spark cuts each sorted run at k before the shuffle, so a large query costs
    k rows per task.
    """
    order = Window.partitionBy("query_id").orderBy(F.round("mass", 12).desc(), "id")
    return walked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
