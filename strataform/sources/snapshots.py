"""Versioned snapshots of an index, shared by several writers.

A version holds chunks and quantised vectors (one byte a dimension and a
scale) as Parquet and names its embedding space; readers pin one.  Writers
work optimistically: each builds on the version it has seen, merges with what
others have published since, and creates the next version exclusively.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions.numbers import dequantize, quantize, quantized_scale
from strataform.operators.embedding import EmbeddingSpace
from strataform.operators.indexing import index_stats
from strataform.operators.merging import merge
from strataform.sources.versions import VersionedTable, VersionTaken

ATTEMPTS = 4


@dataclass
class Loaded:
    """What a load gave; ``index`` is None where there is nothing to use, and ``reason`` says why."""

    index: DataFrame | None
    version: int
    reason: str = ""

    @property
    def loaded(self) -> bool:
        return self.index is not None


def stored(index: DataFrame) -> DataFrame:
    """Chunks with codes and scale in place of the vector."""
    scaled = index.withColumn("scale", quantized_scale(F.col("embedding")))
    return scaled.withColumn("codes", quantize(F.col("embedding"), F.col("scale"))).withColumn("scale", F.col("scale").cast("float")).drop("embedding")


def restored(rows: DataFrame) -> DataFrame:
    """The index of stored rows, vectors at unit length."""
    return rows.withColumn("embedding", dequantize(F.col("codes"), F.col("scale").cast("double")).cast("array<float>")).drop("codes", "scale")


def _checksum(rows: DataFrame) -> list[int]:
    """Number of rows and a sum of their hashes, whatever their order."""
    row = rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*[F.col(c).cast("string") if c == "codes" else F.col(c) for c in sorted(rows.columns)])), F.lit(0)).alias("h")).first()
    return [row["n"], row["h"]]


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str, space: EmbeddingSpace):
        self.space, self.table, self.seen = space, VersionedTable(spark, path), 0

    def load(self, version: int | None = None, verify: bool = False) -> Loaded:
        """The current version, or one by number, if it is of this store's space.

        Nothing is embedded again.  A missing, damaged or foreign snapshot
        isn't an error; a failing file system is.  ``verify`` reads all data
        once and compares its checksum with the manifest's, so that files that
        are damaged, missing or changed count as damaged too.
        """
        version = self.table.current() if version is None else version
        if not version:
            return Loaded(None, 0, "no saved index")
        try:
            manifest = self.table.manifest(version)
            model, revision = manifest["model_id"], manifest["revision"]
        except (ValueError, KeyError, TypeError):
            return Loaded(None, version, "damaged manifest")
        if (model, revision) != (self.space.model_id, self.space.revision):
            return Loaded(None, version, f"made for {model} {revision}")
        if verify:
            try:
                if _checksum(self.table.read("index", version)) != manifest.get("checksum"):
                    return Loaded(None, version, "damaged data")
            except Exception as e:  # Spark names unreadable files in many ways
                return Loaded(None, version, f"damaged data: {str(e)[:100]}")
        self.seen = version
        return Loaded(restored(self.table.read("index", version)), version)

    def spark_read(self, place: str) -> DataFrame:
        return self.table.spark.read.parquet(f"{self.table.path}/{place}")

    def stats(self) -> dict:
        found = self.load()
        if not found.loaded:
            return {"loaded": False, "index_size": 0, "doc_count": 0, "reason": found.reason}
        return {"loaded": True, **index_stats(found.index).first().asDict(), "reason": ""}

    def save(self, index: DataFrame, attempts: int = ATTEMPTS) -> int:
        """Publish an index (``chunk_id, doc_id, text, modified_time, embedding``) as the next version.

        What others have published since this store last looked is merged in
        first; a snapshot that can't be used is replaced.
        """
        mine = index
        for _ in range(attempts):
            base = self.table.current()
            if base and base != self.seen:
                theirs = self.load(base)
                if theirs.loaded:
                    mine = merge(index, theirs.index.select(*index.columns))
            place = self.table.write(stored(mine), "index")
            try:
                self.seen = self.table.publish({"index": place}, base, checksum=_checksum(self.spark_read(place)), model_id=self.space.model_id, revision=self.space.revision, dims=self.space.dims)
                return self.seen
            except VersionTaken:
                continue
        raise VersionTaken(f"gave up after {attempts} attempts")

    def switch(self, space: EmbeddingSpace) -> bool:
        """Change the space; true if the saved index is thereby unusable and must be made again."""
        had = self.load().loaded
        self.space, self.seen = space, 0
        return had and not self.load().loaded
