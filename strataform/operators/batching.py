"""Batches of texts of like length for a model, within a count and a size.

Texts are taken in order of length (or of index) and a batch is closed when
the next text would make it too many or too long; a text over the size is a
batch of its own.  Sorted, the cuts depend on the lengths alone: the fold runs
over the table of lengths, and each text finds its batch by its number within
its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class BatchOptions:
    max_size: int = 32
    max_chars: int = 16_000


def fold(counts: list[tuple[int, int]], options: BatchOptions) -> list[tuple[int, int, int, int, int]]:
    """``length, start, batch, per, place`` from ``(length, count)`` in order of length.

    Text number r >= start of a length stands in batch ``batch + (r - start) //
    per``, at ``place + (r - start) % per``, up to the next row of that length.
    """
    out: list[tuple[int, int, int, int, int]] = []
    batch, held, chars = 0, 0, 0
    for length, n in counts:
        done = 0
        if held:
            room = options.max_size - held
            if length:
                room = min(room, (options.max_chars - chars) // length)
            take = max(0, min(n, room))
            if take:
                out.append((length, 0, batch, take, held))
                held, chars, done = held + take, chars + take * length, take
            if done < n:
                batch, held, chars = batch + 1, 0, 0
        if done < n:
            per = max(1, min(options.max_size, options.max_chars // length if length else options.max_size))
            out.append((length, done, batch, per, 0))
            full, rest = divmod(n - done, per)
            batch += full if rest else full - 1
            held = rest or per
            chars = held * length
    return out


def plan_batches(texts: DataFrame, options: BatchOptions = BatchOptions(), bucket_rows: int = 100_000) -> DataFrame:
    """``idx, batch_id, pos`` for ``idx, text`` (idx unique and not negative), shortest first.

    Null texts count as empty.  The driver sees one row per length, and one
    boundary for ``bucket_rows`` texts: numbers within a length are given by
    ranges of the index that hold equally many texts, however sparse it is, so
    that a length most texts share is spread over many tasks.
    """
    kind = dict(texts.dtypes)["idx"]
    lengths = texts.select("idx", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    ranges = max(1, -(-lengths.count() // bucket_rows))
    cuts = np.array(sorted(set(lengths.agg(F.percentile_approx("idx", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or ())) if ranges > 1 else [], np.int64)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(cuts, b.column(0).to_numpy(), side="right"), pa.int64())], names=["idx", "n", "bucket"])

    rows = lengths.mapInArrow(ranged, f"idx {kind}, n int, bucket long")
    sizes = rows.groupBy("n", "bucket").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("n", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    counts = [(r["n"], r["c"]) for r in rows.groupBy("n").agg(F.count("*").alias("c")).orderBy("n").collect()]
    table = np.array(fold(counts, options), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 40) + table[:, 1]
    inside = F.row_number().over(Window.partitionBy("n", "bucket").orderBy("idx")) - 1
    numbered = rows.withColumn("r", inside).join(offsets, ["n", "bucket"]).select("idx", "n", (F.col("r") + F.col("before")).alias("r"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = b.column("n").to_numpy().astype(np.int64), b.column("r").to_numpy()
            row = table[np.searchsorted(keys, (n << 40) + r, side="right") - 1]
            ahead = r - row[:, 1]
            yield pa.RecordBatch.from_arrays([b.column("idx"), pa.array(row[:, 2] + ahead // row[:, 3]), pa.array(row[:, 4] + ahead % row[:, 3])], names=["idx", "batch_id", "pos"])

    return numbered.mapInArrow(assign, f"idx {kind}, batch_id long, pos long")


def plan_list(lengths: list[int], options: BatchOptions = BatchOptions(), sort: bool = True) -> list[list[int]]:
    """The same plan for a list in memory, by index."""
    order = sorted(range(len(lengths)), key=lambda i: lengths[i]) if sort else range(len(lengths))
    out: list[list[int]] = []
    chars = 0
    for i in order:
        if not out or len(out[-1]) >= options.max_size or chars + lengths[i] > options.max_chars:
            out.append([])
            chars = 0
        out[-1].append(i)
        chars += lengths[i]
    return out
