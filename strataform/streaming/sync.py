"""Following a change feed: each micro-batch updates the published index once.

The feed's offset lives in the stream's checkpoint.  A batch reads the current
version, applies the last intent of every file, and publishes the next
version; the batch number is stored with it, so that a batch that is replayed
after a failure finds itself done.  Documents that fail go to a table of
failures and are tried again with the next batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.operators.changefeed import collapse_changes, removes
from strataform.operators.chunking import CHUNKS, ChunkOptions, chunk_documents
from strataform.operators.embedding import Embedder
from strataform.operators.indexing import update_documents
from strataform.sources.snapshots import restored, stored
from strataform.sources.versions import BUCKET_ROWS, VersionedTable, bucket_of, buckets_for
from strataform.workspace import staged

CHANGE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("file_id", T.StringType()),
        T.StructField("removed", T.BooleanType()),
        T.StructField(
            "file",
            T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("mime_type", T.StringType()), T.StructField("modified_time", T.StringType()), T.StructField("trashed", T.BooleanType())]),
        ),
    ]
)
INDEX = T.StructType([*CHUNKS.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])


def intents(changes: DataFrame) -> DataFrame:
    """``doc_id, intent``: the last effective change of each file in order of seq."""
    kind = F.when(removes(), "remove").when(F.col("file").isNotNull(), "upsert")
    return collapse_changes(changes.withColumn("intent", kind), "file_id", "seq", "intent").select(F.col("file_id").alias("doc_id"), "intent")


class IndexSync:
    """Applies batches of changes to an index in a versioned table.

    ``fetch(doc_ids)`` takes a frame of ``doc_id`` and gives ``doc_id, doc_name,
    text, modified_time, error``, one row a document.
    """

    def __init__(self, spark: SparkSession, path: str, fetch: Callable[[DataFrame], DataFrame], embedder: Embedder = Embedder(), options: ChunkOptions = ChunkOptions()):
        self.spark, self.table, self.fetch, self.embedder, self.options = spark, VersionedTable(spark, path), fetch, embedder, options

    def index(self) -> DataFrame:
        rows = self.table.read("index")
        return self.spark.createDataFrame([], INDEX) if rows is None else restored(rows).select(*INDEX.names)

    def failures(self) -> DataFrame:
        rows = self.table.read("failures")
        return self.spark.createDataFrame([], "doc_id string, error string") if rows is None else rows

    def apply(self, changes: DataFrame, batch_id: int) -> int:
        """One batch; returns the version that holds it."""
        base = self.table.current()
        manifest = self.table.manifest(base) if base else None
        if manifest and manifest.get("batch_id", -1) >= batch_id:
            return base
        since = manifest.get("since") if manifest else None
        wanted = intents(changes if since is None else changes.where(F.col("seq") > since))
        # what failed before is tried again, unless a newer change speaks of it
        again = self.failures().select("doc_id").join(wanted, "doc_id", "left_anti").withColumn("intent", F.lit("upsert"))
        wanted = wanted.unionByName(again)
        got = self.table.write(self.fetch(wanted.where("intent = 'upsert'").select("doc_id")), "fetched")
        fetched = self.spark.read.parquet(f"{self.table.path}/{got}")
        failed = fetched.where("error is not null").select("doc_id", "error")
        chunks = chunk_documents(fetched.where("error is null"), self.options).drop("overlap")
        touched = staged(wanted.join(failed, "doc_id", "left_anti").select("doc_id"), "touched")
        # only the buckets of these documents are read and written; rows of other documents in them stay as they are stored
        held = self.table.bucketed("index", base) if base else None
        n = held["buckets"] if held else buckets_for(0)
        if held and held["rows"] > 2 * BUCKET_ROWS * n:
            n, old, held, hit = buckets_for(held["rows"]), self.table.read("index", base), None, None
            hit = list(range(n))
        else:
            hit = [r["b"] for r in touched.select(bucket_of(F.col("doc_id"), n).alias("b")).distinct().collect()]  # n numbers at most
            old = self.table.read_buckets(hit, "index", base) if held else stored(self.spark.createDataFrame([], INDEX))
        mine = restored(old.join(touched, "doc_id", "left_semi")).select(*INDEX.names)
        fresh = stored(update_documents(mine, chunks, touched, self.embedder))
        rows = staged(old.join(touched, "doc_id", "left_anti").unionByName(fresh), "index-rows")
        part = self.table.rewrite(rows, "doc_id", hit, n, held, "index") | {"rows": (held["rows"] if held else 0) + rows.count()}
        parts = {"index": part, "failures": self.table.write(failed, "failures")}
        return self.table.publish(parts, base, batch_id=batch_id, since=since)

    def baseline(self, changes: DataFrame) -> int:
        """Begin after the newest change of a feed: nothing up to it is ever replayed.

        To be called before a first full index is made, so that changes made
        meanwhile are taken in afterwards.  Does nothing once there is a version.
        """
        base = self.table.current()
        if base:
            return base
        return self.table.publish({}, 0, batch_id=-1, since=changes.agg(F.max("seq")).first()[0])

    def start(self, changes: DataFrame, checkpoint: str, once: bool = True):
        """Follow a streaming frame of changes; ``once`` stops when it has caught up."""
        writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.apply(df, n))
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def change_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A streaming frame over a folder of Parquet files with changes."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_batch).parquet(path)
