"""Filling batches of fixed capacity with texts, leaving little room.

Only lengths decide which texts share a batch, and there are at most
``capacity`` different lengths, whatever the number of texts.  So the plan is
made on the table of lengths with their counts: big lengths open a bin, and as
soon as what is left can be filled exactly by one, two or three further
lengths, found in a hash index of their sums, that combination is used as
often as the counts allow.  What fits nowhere exactly goes, best fit first, to the
fullest bins that can take it.  Texts are then numbered within their length,
and the number alone tells the batch.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strataform.functions.text import is_blank
from strataform.llm.splitting import split_text
from strataform.workspace import staged


@dataclass
class Bins:
    """``count`` bins of one content, first numbered ``base``."""

    content: dict[int, int]
    count: int
    room: int


class _Complements:
    """An index of the sums of one, two and three available lengths.

    ``pairs`` maps a sum to the larger members of the pairs that make it, the
    most unequal last, and is filled on the first question for that sum.  A
    pair at the end is dropped for good once one of its lengths is used up, as
    counts only fall.  At most ``capacity``² / 4 members of four bytes.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts  # by length; falls as lengths are used up
        self.lengths = np.flatnonzero(counts)  # in order; those used up are dropped now and then
        self.pairs: dict[int, array] = {}

    def find(self, gap: int, taken: dict[int, int]) -> tuple[int, ...] | None:
        """Lengths that add up to ``gap``, beside those a bin has taken already."""
        left = lambda x: self.counts[x] - taken.get(x, 0)
        if gap < len(self.counts) and left(gap) > 0:
            return (gap,)
        if pair := self._pair(gap, left):
            return pair
        # the largest member first, so that long lengths go early
        top = int(np.searchsorted(self.lengths, gap - 1))
        for a in self.lengths[:top][::-1].tolist():
            if 3 * a < gap:
                break
            if left(a) > 0 and (pair := self._pair(gap - a, lambda x, a=a: left(x) - (x == a))):
                return (a, *pair)
        return None

    def _pair(self, gap: int, left) -> tuple[int, int] | None:
        if gap < 2:
            return None
        if gap not in self.pairs:
            mine = self.lengths[(self.lengths < gap) & (2 * self.lengths >= gap)]
            other = gap - mine
            self.pairs[gap] = array("i", mine[self.counts[other] > 0].astype(np.int32).tobytes())
        held = self.pairs[gap]
        while held and not (self.counts[held[-1]] and self.counts[gap - held[-1]]):
            held.pop()
        for a in reversed(held):
            b = gap - a
            if left(a) > (a == b) and left(b) > 0:
                return (a, b)
        return None

    def drop_empty(self) -> None:
        self.lengths = self.lengths[self.counts[self.lengths] > 0]


def plan(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Bins for ``counts`` items of each length, none over ``capacity``."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    finder, bins, spare = _Complements(left), [], []
    while True:
        available = np.flatnonzero(left)
        if not len(available):
            break
        content: dict[int, int] = {}
        room, exact = capacity, None
        while room:
            usable = np.flatnonzero(left[: room + 1])[::-1]
            longest = next((int(x) for x in usable if left[x] > content.get(int(x), 0)), 0)
            if content and longest * 3 >= room and (exact := finder.find(room, content)):
                break
            if not longest:
                break
            content[longest] = content.get(longest, 0) + 1
            room -= longest
        for length in exact or ():
            content[length] = content.get(length, 0) + 1
            room -= length
        times = min(int(left[length]) // n for length, n in content.items())
        for length, n in content.items():
            left[length] -= n * times
        finder.drop_empty()
        (spare if room else bins).append(Bins(content, times, room))
    return bins + _best_fit(spare, capacity)


def _best_fit(spare: list[Bins], capacity: int) -> list[Bins]:
    """Bins that aren't full give up their items if these fit into fuller ones."""
    spare = sorted(spare, key=lambda b: b.room)
    kept = [b for b in spare if b.room * 20 <= capacity]
    loose: dict[int, int] = {}
    for b in spare:
        if b.room * 20 > capacity:
            for length, n in b.content.items():
                loose[length] = loose.get(length, 0) + n * b.count
    by_room: dict[int, list[Bins]] = {}
    for b in kept:
        by_room.setdefault(b.room, []).append(b)
    out: list[Bins] = []
    for length in sorted(loose, reverse=True):
        n = loose[length]
        while n:
            room = min((r for r, held in by_room.items() if r >= length and held), default=None)
            if room is None:
                per = max(1, min(capacity // length, n))
                times = n // per
                by_room.setdefault(capacity - per * length, []).append(Bins({length: per}, times, capacity - per * length))
                n -= per * times
                continue
            b = by_room[room].pop()
            per = min(room // length, max(1, n // b.count) if n >= b.count else 1)
            times = min(b.count, n // per)
            if times < b.count:
                by_room[room].append(Bins(dict(b.content), b.count - times, room))
            content = dict(b.content)
            content[length] = content.get(length, 0) + per
            by_room.setdefault(room - per * length, []).append(Bins(content, times, room - per * length))
            n -= per * times
    for held in by_room.values():
        out += held
    return out


def intervals(bins: list[Bins], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``starts, base, per``: item number r of length l, sought as l·2⁴⁰+r, is in
    batch ``base + (r - start) // per`` of the last interval that starts at or before it."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for b in bins:
        for length, per in b.content.items():
            rows.append(((length << 40) + used.get(length, 0), base, per))
            used[length] = used.get(length, 0) + per * b.count
        base += b.count
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 3)
    return columns[:, 0], columns[:, 1], columns[:, 2]


_PARTS = T.StructType([T.StructField("text_hash", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("pieces", T.IntegerType()), T.StructField("part", T.StringType())])


#: Characters of pieces that leave a task at a time.
CUT_CHARS = 4_000_000


def _cut(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=_PARTS.names)
        for batch in batches:
            rows, held = [], 0
            for hashed, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = split_text(text, capacity)
                for i, p in enumerate(found):
                    rows.append((hashed, i, len(found), text[p.start : p.end]))
                    held += p.end - p.start
                    if held > CUT_CHARS:
                        yield batch_of(rows)
                        rows, held = [], 0
            yield batch_of(rows)

    return run


def pack(items: DataFrame, text: Column, capacity: int = 4000, bucket_rows: int = 50_000) -> DataFrame:
    """``batch_id, text_hash, piece, pieces, n_chars, text`` of all distinct texts.

    A batch holds at most ``capacity`` characters.  Null and blank texts are
    left out, repeated ones come once, and only a text over the capacity is cut
    (``pieces`` > 1), at natural boundaries.  No texts give no batches.

    The driver sees one row per length, at most ``capacity`` rows.  Texts of
    one length are numbered by hash bucket, so a length that a third of all
    texts share is spread over many tasks.
    """
    texts = items.select(text.alias("text")).where(~is_blank(F.col("text"))).distinct()
    # hashed before they are cut: a piece never carries the whole text
    hashed = texts.select(F.xxhash64("text").alias("text_hash"), "text")
    whole = hashed.where(F.length("text") <= capacity).select("text_hash", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.col("text").alias("part"))
    over = hashed.where(F.length("text") > capacity).mapInArrow(_cut(capacity), _PARTS)
    parts = whole.unionByName(over).select("text_hash", "piece", "pieces", F.length("part").alias("n_chars"), F.col("part").alias("text"))
    parts = staged(parts, "pack-parts")
    counts = {r["n_chars"]: r["n"] for r in parts.groupBy("n_chars").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, -(-sum(counts.values()) // bucket_rows))
    starts, base, per = intervals(plan(counts, capacity), capacity)

    bucketed = parts.withColumn("bucket", F.pmod(F.xxhash64("text_hash", "piece"), F.lit(buckets)))
    sizes = bucketed.groupBy("n_chars", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("n_chars").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("n_chars", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("n_chars", "bucket").orderBy("text_hash", "piece", "text")) - 1
    numbered = bucketed.withColumn("place", place).join(offsets, ["n_chars", "bucket"]).withColumn("number", F.col("place") + F.col("before"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("n_chars").to_numpy().astype(np.int64)
            number = batch.column("number").to_numpy()
            at = np.searchsorted(starts, (length << 40) + number, side="right") - 1
            batch_id = base[at] + (number - (starts[at] - (length << 40))) // per[at]
            yield pa.RecordBatch.from_arrays([pa.array(batch_id), *(batch.column(c) for c in _OUT.names[1:])], names=_OUT.names)

    return numbered.select("text_hash", "piece", "pieces", "n_chars", "text", "number").mapInArrow(assign, _OUT)


_OUT = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("text_hash", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("pieces", T.IntegerType()),
        T.StructField("n_chars", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)
