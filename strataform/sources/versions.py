"""Versioned tables on plain files: data first, then an exclusive manifest.

A version is a folder of Parquet files that no reader looks at until a
manifest naming it exists.  The manifest is created with "fail if it exists",
so of two writers of the same version number exactly one wins and the other
raises :class:`VersionTaken`.  A crash before that leaves only an unreferenced
folder; a reader sees the old version or the new one, never a mixture.

A part may be kept in buckets, hashed by a key.  Then a version names a place
for each bucket, and the next version writes only the buckets it touches and
names the others where they are.
"""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataform.workspace import hadoop


#: Rows for which a part gets a bucket, and the fewest buckets.  At twice as many rows a bucket, a part is hashed anew.
BUCKET_ROWS, LEAST_BUCKETS = 200_000, 8
BUCKET = "_bucket"


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


class VersionTaken(RuntimeError):
    """Another writer published this version number first."""


class VersionedTable:
    """A table whose versions are published one after the other."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        fs, p = hadoop(self.spark, f"{self.path}/manifests")
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def current(self) -> int:
        """The newest published version; 0 if there is none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict | None:
        version = self.current() if version is None else version
        if not version:
            return None
        fs, p = hadoop(self.spark, f"{self.path}/manifests/v{version:08d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def write(self, df: DataFrame, part: str = "data") -> str:
        """Write a folder no manifest names yet; returns its place in the table."""
        place = f"{part}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{place}")
        return place

    def bucketed(self, part: str = "data", version: int | None = None) -> dict | None:
        """``buckets, rows, schema, places`` of a part kept in buckets; None if there is none."""
        manifest = self.manifest(version)
        found = manifest["parts"].get(part) if manifest else None
        return found if isinstance(found, dict) else None

    def read_buckets(self, wanted: list[int], part: str = "data", version: int | None = None) -> DataFrame:
        """The rows of some buckets of a part that is kept in buckets."""
        held = self.bucketed(part, version)
        schema = StructType.fromJson(held["schema"])
        places = [f"{self.path}/{held['places'][str(b)]}" for b in wanted if str(b) in held["places"]]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def rewrite(self, rows: DataFrame, key: str, touched: list[int], buckets: int, held: dict | None = None, part: str = "data") -> dict:
        """Write the rows of the touched buckets; the other buckets of ``held`` stay where they are.

        ``rows`` are all rows of the touched buckets.  Gives the part to publish.
        """
        place = f"{part}/{uuid.uuid4().hex}"
        marked = rows.withColumn(BUCKET, bucket_of(F.col(key), buckets))
        marked.repartition(max(1, len(touched)), BUCKET).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.path}/{place}")
        fs, p = hadoop(self.spark, f"{self.path}/{place}")
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        fresh = {n.split("=")[1]: f"{place}/{n}" for n in names if n.startswith(f"{BUCKET}=")}
        gone = {str(b) for b in touched}
        places = {b: x for b, x in (held["places"] if held else {}).items() if b not in gone} | fresh
        return {"buckets": buckets, "schema": rows.schema.jsonValue(), "places": places}

    def publish(self, parts: dict[str, str | dict], expected: int | None = None, **info) -> int:
        """Make written parts the version after ``expected`` (default: the current one)."""
        version = (self.current() if expected is None else expected) + 1
        fs, p = hadoop(self.spark, f"{self.path}/manifests/v{version:08d}.json")
        body = json.dumps({"version": version, "parts": parts} | info).encode()
        if not self._create(fs, p, body):
            raise VersionTaken(f"version {version} of {self.path} exists")
        return version

    def _create(self, fs, p, body: bytes) -> bool:
        """Make a whole file appear at once; false if it exists.

        A finished temporary file gets its name by an operation that fails on
        an existing one: a hard link on a mounted folder, a rename elsewhere.
        Object stores have no such rename; there the store's own exclusive
        create decides.
        """
        fs.mkdirs(p.getParent())
        scheme = fs.getUri().getScheme()
        if scheme == "file":
            final = p.toUri().getPath()
            draft = f"{final}.{uuid.uuid4().hex}.tmp"
            Path(draft).write_bytes(body)
            try:
                os.link(draft, final)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        stores = scheme in ("s3", "s3a", "gs", "abfs", "abfss", "wasb", "wasbs")
        draft = p if stores else p.suffix(f".{uuid.uuid4().hex}.tmp")
        try:
            out = fs.create(draft, False)
        except Exception:
            if stores and fs.exists(p):
                return False
            raise
        out.write(body)
        out.close()
        if stores or fs.rename(draft, p):
            return True
        fs.delete(draft, False)
        return False

    def read(self, part: str = "data", version: int | None = None, schema: StructType | None = None) -> DataFrame | None:
        """One version of a part; None before the first version."""
        manifest = self.manifest(version)
        if manifest is None or part not in manifest["parts"]:
            return None
        place = manifest["parts"][part]
        if isinstance(place, dict):
            rows = self.read_buckets(list(range(place["buckets"])), part, version)
            return rows if schema is None else rows.select(*schema.names)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/{place}")


__all__ = ["VersionTaken", "VersionedTable", "bucket_of", "buckets_for"]
