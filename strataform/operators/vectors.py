"""Tables of vectors: adding, removing, looking up and exact search.

Vectors are stored at unit length, so that cosine is an inner product.  The
search is exact: a stated set of queries runs over all vectors in blocks.  A
block's matrix (at most ``QUERY_BLOCK`` queries) is multiplied with each Arrow
batch of vectors once, and only the best of a batch leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strataform.functions.numbers import unit

#: Bound of a broadcast block of queries (4,096 x 384 doubles are 12 MB).
QUERY_BLOCK = 4096
#: Vectors of a task where several blocks of queries meet them.
VECTOR_BLOCK = 32_768


def checked(vectors: DataFrame, dims: int, column: str = "embedding") -> DataFrame:
    """The same rows; a vector of another length fails the job."""
    ok = F.size(column) == dims
    return vectors.where(F.when(F.col(column).isNull() | ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"expected {dims} dims, got "), F.size(column).cast("string"))).cast("boolean")))


def normalized(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn(column, unit(F.col(column)))


def add(table: DataFrame, rows: DataFrame, dims: int) -> DataFrame:
    """Appended rows; ids aren't checked for repetition."""
    return table.unionByName(checked(rows, dims))


def get(table: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The rows of some ids; absent ids give nothing."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def remove(table: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The table without some ids; absent ids change nothing."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def top(hits: DataFrame, k: int, group: str, score: Column, *ties: Column) -> DataFrame:
    """The best k of a group with their rank.  Spark cuts each sorted run at k before it shuffles."""
    order = Window.partitionBy(group).orderBy(score.desc(), *ties)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int, id_type: str = "string") -> DataFrame:
    """``query_id, id, score, rank`` of the k nearest vectors of each query, by cosine.

    ``vectors`` has ``id, embedding``, ``queries`` has ``query_id, embedding``
    (a stated set; ids as ``id_type``).  Vectors count as they are, the query is
    normalised; a zero query scores 0 everywhere.  Null vectors are left out, k
    of 0 or less gives nothing.  Scores that agree to twelve places tie and
    come in order of id.

    Up to ``QUERY_BLOCK`` queries are broadcast, and the vectors are read once
    where they lie.  More are cut into blocks, and every block of queries meets
    every block of vectors in a task of its own; nothing of either comes to the
    driver, and the plan is the same for any number of blocks.
    """
    spark = vectors.sparkSession
    schema = f"query_id {id_type}, id {id_type}, score double"
    if k <= 0:
        return spark.createDataFrame([], schema + ", rank int")
    stated = queries.where("embedding is not null").select("query_id", unit(F.col("embedding")).alias("embedding"))
    rows = vectors.where("embedding is not null").select("id", "embedding")
    first = stated.limit(QUERY_BLOCK + 1).toArrow()  # most searches are one block, told by one job
    if not first.num_rows:
        return spark.createDataFrame([], schema + ", rank int")
    if first.num_rows <= QUERY_BLOCK:
        shared = spark.sparkContext.broadcast((first.column(0).to_pylist(), _matrix(first.column(1).combine_chunks(), None)))
        hits = rows.mapInArrow(_nearest(shared, k), schema)
    else:
        q_blocks, v_blocks = -(-stated.count() // QUERY_BLOCK), -(-rows.count() // VECTOR_BLOCK)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        block = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
        v = rows.withColumn("v", block("id", v_blocks)).withColumn("q", every(q_blocks))
        q = stated.withColumn("q", block("query_id", q_blocks)).withColumn("v", every(v_blocks))
        hits = v.groupBy("v", "q").cogroup(q.groupBy("v", "q")).applyInArrow(_nearest_in_cell(k, schema), schema)
    return top(hits, k, "query_id", F.col("score"), F.col("id"))


def _matrix(column: pa.Array, dims: int | None) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    if dims is not None and x.shape[1] != dims:
        raise ValueError(f"expected {dims} dims, got {x.shape[1]}")
    return x


def _best(queries: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and score of the k best of each query and of all that tie with the k-th, so that ids decide over all of them."""
    scores = np.round(queries @ x.T, 12)
    n = min(k, scores.shape[1])
    cut = np.partition(scores, -n, axis=1)[:, -n]
    q, at = np.nonzero(scores >= cut[:, None])
    return q, at, scores[q, at]


def _nearest(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        names = pa.array(ids)
        for batch in batches:
            if batch.num_rows:
                q, at, s = _best(queries, _matrix(batch.column(1), queries.shape[1]), k)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch.column(0).take(pa.array(at)), pa.array(s)], names=["query_id", "id", "score"])

    return run


def _nearest_in_cell(k: int, schema: str):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        names, out = queries["query_id"], []
        q_all = _matrix(queries["embedding"].combine_chunks(), None) if queries.num_rows else None
        for batch in vectors.to_batches() if queries.num_rows else ():
            if batch.num_rows:
                q, at, s = _best(q_all, _matrix(batch.column("embedding"), q_all.shape[1]), k)
                out.append(pa.table({"query_id": names.take(pa.array(q)), "id": batch.column("id").take(pa.array(at)), "score": pa.array(s)}))
        return pa.concat_tables(out) if out else pa.table({"query_id": names.slice(0, 0), "id": vectors["id"].slice(0, 0), "score": pa.array([], pa.float64())})

    return run


class Resident:
    """A small table of vectors held in the driver's memory, for single questions without a job.

    Only up to ``most`` vectors are taken (an index of one person's documents);
    a larger table raises, and is searched by :func:`search`.
    """

    def __init__(self, vectors: DataFrame, most: int = 200_000):
        rows = vectors.where("embedding is not null").select("id", "embedding").limit(most + 1).toArrow()
        if rows.num_rows > most:
            raise ValueError(f"more than {most} vectors don't stay resident; use search()")
        self.ids = np.array(rows.column(0).to_pylist(), object)
        column = rows.column(1).combine_chunks()
        self.x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 0), np.float32)

    def search(self, query, k: int) -> list[tuple[object, float]]:
        """``id, score`` of the k nearest; candidates in single precision, their scores and order in double."""
        q = np.asarray(query, np.float64)
        if not len(self.ids) or k <= 0:
            return []
        if q.shape != (self.x.shape[1],):
            raise ValueError(f"expected {self.x.shape[1]} dims, got {q.size}")
        q = q / (np.linalg.norm(q) or 1.0)
        rough = self.x @ q.astype(np.float32)
        n = min(k, len(rough))
        margin = 1e-5 * max(1.0, float(np.abs(rough).max()))
        at = np.flatnonzero(rough >= np.partition(rough, -n)[-n] - margin)
        scores = np.round(self.x[at].astype(np.float64) @ q, 12)
        order = sorted(range(len(at)), key=lambda i: (-scores[i], self.ids[at[i]]))[:k]
        return [(self.ids[at[i]], float(scores[i])) for i in order]
