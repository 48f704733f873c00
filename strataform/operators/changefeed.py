"""Rebuilding a table of files from a feed of inserts, updates and deletes.

The feed is applied by embedded DuckDB engines, one per bucket, in two levels:

1. every input split runs the upsert over its own rows and hands on one row
   per file, so that a file holding a third of the feed crosses the shuffle as
   one row per split;
2. files are hashed into buckets and each bucket runs the same upsert over
   what the splits handed on.

The upsert is a conditional conflict update: a stored row is replaced only by
a change that stands later in the full order of changes (sequence, receipt,
content), the same within a batch and between batches.  It is therefore idempotent and commutative,
and repeated, late or out-of-order rows cannot change the result.  Removals
stay as tombstones, so that an old write arriving after a removal loses.  All
bucket results become visible together when the version is published.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.sources.versions import BUCKET_ROWS, VersionedTable, bucket_of, buckets_for
from strataform.workspace import discard, run_dir, staged

DOCUMENT_MIME = "application/vnd.google-apps.document"
FIELDS = ("id", "name", "mime_type", "modified_time", "trashed")
STATE = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("received", T.LongType()),
        T.StructField("tombstone", T.BooleanType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("modified_time", T.StringType()),
        T.StructField("trashed", T.BooleanType()),
    ]
)


def removes(removed: str = "removed", file: str = "file", mime: str = DOCUMENT_MIME) -> Column:
    """Whether a change takes its file away (null flags mean false)."""
    f = F.col(file)
    return (
        F.coalesce(F.col(removed), F.lit(False))
        | F.coalesce(f["trashed"], F.lit(False))
        | (f.isNotNull() & ~F.coalesce(f["mime_type"] == mime, F.lit(False)))
    )


def effective(changes: DataFrame, mime: str = DOCUMENT_MIME) -> DataFrame:
    """Changes that do something, in the shape of the state table.

    A change without a file id or a sequence names no file or no place in the
    order and is left out, as is one that neither removes nor carries a file.
    """
    gone, f = removes(mime=mime), F.col("file")
    return changes.where(
        F.col("file_id").isNotNull() & F.col("seq").isNotNull() & (gone | f.isNotNull())
    ).select(
        "file_id",
        F.col("seq").cast("long").alias("seq"),
        F.coalesce(F.unix_micros("received_at"), F.lit(0)).alias("received"),
        gone.alias("tombstone"),
        *[F.when(~gone, f[c]).alias(c) for c in FIELDS],
    )


_COLUMNS = ", ".join(f.name for f in STATE.fields)
_CREATE = """create table state (file_id varchar primary key, seq bigint, received bigint, tombstone boolean,
    id varchar, name varchar, mime_type varchar, modified_time varchar, trashed boolean)"""


def _order(side: str) -> str:
    """The full order of changes: of one sequence the later received counts, then the content, so that no two rows tie unless they are equal."""
    texts = ("name", "id", "mime_type", "modified_time")
    return f"row({side}.seq, {side}.received, {side}.tombstone, " + ", ".join(f"coalesce({side}.{c}, '')" for c in texts) + f", coalesce({side}.trashed, false))"


_UPSERT = f"""
insert into state
select {_COLUMNS} from incoming
qualify row_number() over (partition by file_id order by {_order("incoming")} desc) = 1
on conflict (file_id) do update set {", ".join(f"{f.name} = excluded.{f.name}" for f in STATE.fields[1:])}
where {_order("excluded")} > {_order("state")}
"""
#: Memory of an engine; beyond, it spills to a folder of its task, which goes with the task.
ENGINE_MEMORY = "512MB"


def upsert_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply batches of changes to an embedded table; yield its rows, tombstones too."""
    import duckdb
    from pyspark import SparkFiles

    # scratch of this task only, in Spark's own local folder: nothing in it is ever read by another task
    scratch = tempfile.mkdtemp(prefix="upsert-", dir=SparkFiles.getRootDirectory())
    con = duckdb.connect(":memory:", config={"threads": "1", "temp_directory": scratch, "memory_limit": ENGINE_MEMORY})
    try:
        con.execute(_CREATE)
        for group in _gathered(batches):
            con.register("incoming", group)
            con.execute(_UPSERT)
            con.unregister("incoming")
        result = con.sql(f"select {_COLUMNS} from state").to_arrow_reader(20_000)
        for batch in result:
            yield pa.Table.from_batches([batch]).cast(_arrow_schema()).combine_chunks().to_batches()[0] if batch.num_rows else pa.RecordBatch.from_pylist([], _arrow_schema())
    finally:
        con.close()
        shutil.rmtree(scratch, ignore_errors=True)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.Table]:
    """Fewer, larger inputs: one statement per ~50,000 rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in STATE.fields])


def apply_changes(
    changes: DataFrame, target: VersionedTable | None = None, buckets: int | None = None, mime: str = DOCUMENT_MIME
) -> VersionedTable:
    """Apply a feed to the target's current version and publish the next one.

    ``changes`` needs ``seq, file_id, removed, file, received_at``; further
    columns are ignored.  The stored rows, tombstones included, go through the
    same upsert as the new ones, so applying a feed again, in parts, or in any
    order gives the same table.  An empty feed publishes an unchanged version.

    Only buckets with a changed file are read and written.  Their number
    follows the number of files, so that an engine's table stays small.
    """
    spark = changes.sparkSession
    target = target or VersionedTable(spark, f"{run_dir(spark)}/files-{uuid.uuid4().hex[:10]}")
    base = target.current()
    held = target.bucketed(version=base) if base else None
    local = staged(effective(changes, mime).mapInArrow(upsert_batches, STATE), "feed-local")  # a row per file and split
    n = buckets or (held["buckets"] if held else buckets_for(local.count()))
    stored = held["rows"] if held else 0
    if held and (n != held["buckets"] or stored > 2 * BUCKET_ROWS * n):  # grown: all rows are hashed anew
        n = n if n != held["buckets"] else buckets_for(stored)
        rows, held, touched = local.unionByName(target.read(version=base, schema=STATE)), None, list(range(n))
    else:
        touched = [r["b"] for r in local.select(bucket_of(F.col("file_id"), n).alias("b")).distinct().collect()]  # n numbers at most
        rows = local.unionByName(target.read_buckets(touched, version=base)) if held else local
    newest = rows.repartition(max(1, len(touched)), bucket_of(F.col("file_id"), n)).mapInArrow(upsert_batches, STATE)
    part = target.rewrite(newest, "file_id", touched, n, held)
    target.publish({"data": part | {"rows": stored + local.count()}}, expected=base)  # an upper bound of the rows
    discard(local)
    return target


def existing_files(target: VersionedTable) -> DataFrame:
    """The files that exist in the current version, without tombstones."""
    state = target.read(schema=STATE)
    return state.where(~F.col("tombstone")).drop("tombstone", "received")


def collapse_changes(changes: DataFrame, key: str, order: str, intent: str) -> DataFrame:
    """Last intent per key: ``remove`` or ``upsert``; rows of any other intent are ignored.

    One aggregate instead of a window: combined before the shuffle, so a hot
    key costs one row per input split.
    """
    last = F.max_by(F.col(intent), F.col(order))
    return (
        changes.where(F.col(intent).isin("remove", "upsert") & F.col(key).isNotNull())
        .groupBy(key)
        .agg(last.alias("intent"), F.max(order).alias("last_order"))
    )
