"""The most similar vectors, by an inverted file with product-quantised residuals.

Fitting looks at bounded samples: coarse centroids by spherical k-means, and
codebooks for slices of what is left after the nearest centroid is taken away.
There are as many lists as the square root of the number of vectors.  While a
sample on the driver can tell them, they are fitted there; beyond, regions are
fitted on the driver and each region's lists on an executor, from a sample of
the region that is bounded by its number of lists.
Indexing looks at every vector: it goes to the list of its nearest centroid,
as codes of one byte per slice and as the vector itself.  A query visits the
lists of its nearest centroids.  There the similarity of every member is
estimated from one table of slice products per query (the query isn't
quantised), the best of a list are compared exactly, and the best of all lists
are kept.

Lists lie in groups of neighbouring centroids, a group for about
``VECTOR_BLOCK`` vectors, so that a query crosses the shuffle once or twice
instead of once per list.  A group expected to be larger is cut into blocks of
vectors and blocks of queries, so that a crowded region is spread over many
tasks and no task holds more than a block of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Bounds of what is fitted: rows on the driver, rows a list in either place, and lists (hence of what is broadcast: 65,536 x dims
#: floats are 100 MB at 384 dims, reached at 4 billion vectors; beyond, lists grow longer).
SAMPLE, PER_LIST, MAX_LISTS = 16_384, 8, 65_536
#: Rows that one region's fit may hold.
REGION_ROWS = 16_384
SLICE, CODES = 8, 256
PROBES, RERANK, K = 8, 100, 10
#: Ids that the exact search holds at a time.
EXACT_IDS = 5000
VECTOR_BLOCK, QUERY_BLOCK = 8_192, 32_768
#: Up to so many query ids (about 50 bytes each) a broadcast picks the queries from the vectors; beyond, a shuffle does.
BROADCAST_IDS = 200_000


@dataclass
class Index:
    """What is fitted: centroids, their groups, codebooks, and blocks per group."""

    dims: int
    centroids: np.ndarray  # lists x dims
    group: np.ndarray  # of each list
    books: np.ndarray  # slices x codes x width
    vector_blocks: np.ndarray  # of each group
    query_blocks: np.ndarray


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """``chunk_id, embedding`` of the rows with ``dims`` finite numbers, not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("chunk_id").isNotNull() & (F.size("embedding") == dims) & finite & F.exists("embedding", lambda x: x != 0)).select("chunk_id", "embedding")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of unit length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return (x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)).astype(np.float32)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    centroids = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float32)
    for _ in range(rounds):
        if spherical:
            at = _nearest(x, centroids)
        else:
            at = (x @ centroids.T - (centroids**2).sum(axis=1) / 2).argmax(axis=1)
        order = np.argsort(at, kind="stable")
        n = np.bincount(at, minlength=k)
        full = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.r_[0, np.cumsum(n[full])[:-1]], axis=0)
        centroids[full] = sums / n[full, None]
        if len(full) < k:
            centroids[n == 0] = x[rng.choice(len(x), k - len(full))]
        if spherical:
            centroids /= np.linalg.norm(centroids, axis=1, keepdims=True) + 1e-12
    return centroids


def _slices(x: np.ndarray) -> np.ndarray:
    """Rows cut into slices; the last one filled up with zeros."""
    pad = -x.shape[1] % SLICE
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SLICE)


def lists_for(rows: int) -> int:
    """The square root of the number of vectors, so that a query's work grows with it and not with the vectors."""
    return int(max(1, min(MAX_LISTS, round(rows**0.5))))


def coarse(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of lists or regions, at most one for ``PER_LIST`` rows of the sample."""
    return kmeans(sample, int(max(1, min(lists, len(sample) // PER_LIST or 1))), 8, np.random.default_rng(seed), True)


def refined(good: DataFrame, rows: int, sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of more lists than the sample can tell, fitted on executors region by region.

    A region is as large as ``REGION_ROWS`` rows of sample allow; crowded
    places have more regions, as centroids follow the vectors.  Only centroids
    come back, ``lists`` rows.
    """
    dims = sample.shape[1]
    most = REGION_ROWS // PER_LIST  # lists of a region
    regions = coarse(sample, max(2, 4 * lists // most, round(lists**0.5)), seed)
    share = np.bincount(_nearest(sample, regions), minlength=len(regions)) / len(sample)
    quota = np.maximum(1, np.minimum(most, np.round(lists * share))).astype(np.int64)
    rate = np.minimum(1.0, quota * PER_LIST / np.maximum(1.0, share * rows))
    shared = good.sparkSession.sparkContext.broadcast((regions, quota, rate))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regions, quota, rate = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dims)
            at = _nearest(x, regions)
            keep = np.flatnonzero(_hashed(batch.column(0).to_pylist(), 3) / 2.0**64 < rate[at])
            yield pa.RecordBatch.from_arrays([pa.array(at[keep], pa.int64()), pa.array([x[i].tobytes() for i in keep], pa.binary())], names=["region", "vector"])

    def fit_region(rows: pa.Table) -> pa.Table:
        region = int(rows["region"][0].as_py())
        x = _floats(rows["vector"], dims)
        found = kmeans(x, int(max(1, min(shared.value[1][region], len(x) // 2 or 1))), 8, np.random.default_rng(seed + region), True)
        return pa.table({"region": pa.array([region] * len(found), pa.int64()), "vector": pa.array([v.tobytes() for v in found], pa.binary())})

    fitted = good.mapInArrow(route, "region long, vector binary").groupBy("region").applyInArrow(fit_region, "region long, vector binary")
    return _floats(fitted.orderBy("region").toArrow()["vector"], dims).copy()


def fit(sample: np.ndarray, rows: int, queries: int, probes: int = PROBES, seed: int = 7, centroids: np.ndarray | None = None) -> Index:
    """An index for ``rows`` vectors and ``queries`` queries like those of the sample."""
    rng = np.random.default_rng(seed)
    centroids = coarse(sample, lists_for(rows), seed) if centroids is None else centroids
    at = _nearest(sample, centroids)
    groups = int(max(1, min(len(centroids), round(rows / VECTOR_BLOCK))))
    middle = kmeans(centroids, groups, 8, rng, True)
    group = _nearest(centroids, middle)
    left = _slices((sample - centroids[at])[:SAMPLE])
    books = np.stack([kmeans(left[:, m], CODES, 6, rng, False) for m in range(left.shape[1])])
    share = np.bincount(group[at], minlength=groups) / len(sample)
    visits = np.zeros(groups)
    for i in range(0, len(sample), 1024):
        near = np.argsort(-(sample[i : i + 1024] @ centroids.T), axis=1)[:, :probes]
        for g in (np.unique(row) for row in group[near]):
            visits[g] += 1
    blocks = lambda expected, size: np.maximum(1, np.ceil(expected / size)).astype(np.int64)
    return Index(sample.shape[1], centroids, group, books, blocks(share * rows, 2 * VECTOR_BLOCK), blocks(visits / len(sample) * queries, QUERY_BLOCK))


def _floats(column, dims: int) -> np.ndarray:
    """Rows of a binary column of equal lengths, without a copy where Arrow holds one buffer."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
    begin, data = (np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0), column.buffers()[2]
    return np.frombuffer(data, np.float32, len(column) * dims, begin).reshape(-1, dims) if len(column) else np.zeros((0, dims), np.float32)


def _cell(group: int, vector_block: int, query_block: int) -> int:
    return (group << 40) | (vector_block << 20) | query_block


def _hashed(ids: list[str], seed: int) -> np.ndarray:
    return pd.util.hash_array(np.array(ids, object), hash_key=f"{seed:016d}").astype(np.uint64)


VECTORS = T.StructType(
    [T.StructField("cell", T.LongType()), T.StructField("list", T.IntegerType()), T.StructField("chunk_id", T.StringType()), T.StructField("codes", T.BinaryType()), T.StructField("vector", T.BinaryType())]
)
QUERIES = T.StructType([T.StructField("cell", T.LongType()), T.StructField("query_id", T.StringType()), T.StructField("lists", T.ArrayType(T.IntegerType())), T.StructField("vector", T.BinaryType())])
NEAR = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("chunk_id", T.StringType()), T.StructField("similarity", T.DoubleType())])


def _index_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(**shared.value)
        offsets = (index.books**2).sum(axis=2) / 2
        for batch in batches:
            ids = batch.column(0).to_pylist()
            if not ids:
                continue
            x = _matrix(batch.column(1), index.dims)
            lists = _nearest(x, index.centroids)
            left = _slices(x - index.centroids[lists])
            codes = np.empty(left.shape[:2], np.uint8)
            for m in range(left.shape[1]):
                codes[:, m] = (left[:, m] @ index.books[m].T - offsets[m]).argmax(axis=1)
            group = index.group[lists]
            block = (_hashed(ids, 1) % index.vector_blocks[group].astype(np.uint64)).astype(np.int64)
            copies = index.query_blocks[group]
            row = np.repeat(np.arange(len(ids)), copies)
            copy = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            cells = (group[row] << 40) | (block[row] << 20) | copy
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cells, pa.int64()),
                    pa.array(lists[row], pa.int32()),
                    batch.column(0).take(pa.array(row)),
                    pa.array([codes[i].tobytes() for i in row], pa.binary()),
                    pa.array([x[i].tobytes() for i in row], pa.binary()),
                ],
                names=VECTORS.names,
            )

    return run


def _query_batches(shared, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(**shared.value)
        probes_ = min(probes, len(index.centroids))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            if not ids:
                continue
            x = _matrix(batch.column(1), index.dims)
            cells, names, lists, vectors = [], [], [], []
            hashed = _hashed(ids, 2)
            for i in range(0, len(ids), 2048):
                scores = x[i : i + 2048] @ index.centroids.T
                near = np.argpartition(-scores, probes_ - 1, axis=1)[:, :probes_]
                for j, row in enumerate(near, i):
                    groups = index.group[row]
                    blob = x[j].tobytes()
                    for g in np.unique(groups):
                        mine = row[groups == g].tolist()
                        q = int(hashed[j] % np.uint64(index.query_blocks[g]))
                        for v in range(int(index.vector_blocks[g])):
                            cells.append(_cell(int(g), v, q))
                            names.append(ids[j])
                            lists.append(mine)
                            vectors.append(blob)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(names, pa.string()), pa.array(lists, pa.list_(pa.int32())), pa.array(vectors, pa.binary())], names=QUERIES.names)

    return run


def _once(names: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows without the repetitions of an id with the same vector."""
    mixed = x.view(np.uint32).astype(np.uint64) @ np.arange(1, 2 * x.shape[1], 2, dtype=np.uint64)
    return np.flatnonzero(~pd.DataFrame({"n": names, "h": mixed}).duplicated().to_numpy())


def _search_cell(shared, k: int, rerank: int):
    schema = pa.schema([("query_id", pa.string()), ("chunk_id", pa.string()), ("similarity", pa.float64())])

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        index = Index(**shared.value)
        names, x = vectors["chunk_id"].to_numpy(), _floats(vectors["vector"], index.dims)
        width = len(index.books)
        codes = np.frombuffer(b"".join(vectors["codes"].to_pylist()), np.uint8).reshape(-1, width)
        # a repeated row lies in the same cell as its first, hence counts once; so does a repeated query
        keep = _once(names, x)
        lists = vectors["list"].to_numpy()
        if len(keep) < len(names):
            names, x, codes, lists = names[keep], x[keep], codes[keep], lists[keep]
        q_names, q = queries["query_id"].to_numpy(), _floats(queries["vector"], index.dims)
        once = _once(q_names, q)
        if len(once) < len(q_names):
            queries, q_names, q = queries.take(pa.array(once)), q_names[once], q[once]
        visited = queries["lists"].combine_chunks()
        visit_list, visit_query = visited.values.to_numpy(), np.repeat(np.arange(len(q)), np.diff(visited.offsets.to_numpy()))
        several = len(pd.unique(names)) < len(names) or len(pd.unique(q_names)) < len(q_names)
        firsts = pd.unique(q_names) if several else q_names
        most = k if not several else k * max(1, int(pd.Series(names).value_counts().iloc[0]))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for one in np.unique(lists):
            members = np.flatnonzero(lists == one)
            asking = visit_query[visit_list == one]
            if not len(asking):
                continue
            held = x[members]
            mine = np.ascontiguousarray(codes[members].T).astype(np.intp)
            depth = min(len(members), max(rerank, most + 1))
            for i in range(0, len(asking), 128):
                who = asking[i : i + 128]
                ask = q[who]
                if len(members) > depth:
                    # slice products of all queries, codes first: a row of the table holds all queries
                    table = np.einsum("qms,mcs->mcq", _slices(ask), index.books, optimize=True)
                    guess = np.zeros((len(members), len(who)), np.float32)
                    for m in range(len(mine)):
                        guess += table[m][mine[m]]
                    best = np.argpartition(-guess, depth - 1, axis=0)[:depth].T
                    exact = np.einsum("qd,qrd->qr", ask, held[best])
                else:
                    best = np.broadcast_to(np.arange(len(members)), (len(who), len(members)))
                    exact = ask @ held.T
                exact = np.where(names[members[best]] == q_names[who][:, None], -2.0, exact)
                top = np.argsort(-exact, axis=1, kind="stable")[:, :most]
                s = np.take_along_axis(exact, top, 1)
                rows = np.repeat(who, top.shape[1])
                at = members[np.take_along_axis(best, top, 1)].ravel()
                s = s.ravel()
                found.append((rows[s > -2], at[s > -2], s[s > -2]))
        if not found:
            return schema.empty_table()
        rows, at, s = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((-s, rows))
        rows, at, s = rows[order], at[order], s[order]
        if several:  # of an id with several vectors the nearest counts, on either side
            asks = pd.factorize(q_names)[0][rows]
            fresh = ~pd.DataFrame({"q": asks, "n": names[at], "s": -s}).sort_values(["q", "s"], kind="stable").drop_duplicates(["q", "n"]).index.to_series().reindex(range(len(rows))).isna().to_numpy()
            rows, at, s = asks[fresh], at[fresh], s[fresh]
            order = np.lexsort((-s, rows))
            rows, at, s = rows[order], at[order], s[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        ok = place < k
        return pa.table({"query_id": pa.array(firsts[rows[ok]], pa.string()), "chunk_id": pa.array(names[at[ok]], pa.string()), "similarity": pa.array(s[ok].astype(np.float64))}, schema=schema)

    return run


def nearest(vectors: DataFrame, dims: int, ids: DataFrame | None = None, k: int = K, probes: int = PROBES, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """``query_id, chunk_id, similarity, place``: the k most similar of each query.

    ``vectors`` has ``chunk_id, embedding`` of one space; ``ids`` the
    ``chunk_id`` of the queries (default: all).  A chunk is never its own
    neighbour, a repeated row counts once, ids without a usable vector have no
    rows, fewer than k others give fewer rows, no vectors give none.  Of an id
    with several vectors the nearest counts, as a query and as a neighbour.
    Equal similarities come in order of id.
    """
    spark = vectors.sparkSession
    good = usable(vectors, dims)
    rows = vectors.count()  # of ids only: the embeddings aren't read for it
    every = max(1, -(-rows // sample))
    picked = good.where(F.pmod(F.xxhash64("chunk_id"), F.lit(every)) == 0).select("embedding").limit(sample + sample // 4).toArrow()
    x = _matrix(picked.column(0), dims) if picked.num_rows else np.zeros((0, dims), np.float32)
    if not len(x) and every > 1:
        x = _matrix(good.select("embedding").limit(sample).toArrow().column(0), dims)
    if not len(x):
        return spark.createDataFrame([], T.StructType([*NEAR.fields, T.StructField("place", T.IntegerType())]))
    asked = good
    queries = rows
    if ids is not None:
        wanted = ids.select("chunk_id").distinct()
        queries = wanted.count()
        asked = good.join(F.broadcast(wanted) if queries <= BROADCAST_IDS else wanted, "chunk_id", "left_semi")
    lists = lists_for(rows)
    centroids = refined(good, rows, x, lists) if lists > len(x) // PER_LIST and every > 1 else None
    shared = spark.sparkContext.broadcast(vars(fit(x, rows, queries, probes, centroids=centroids)))  # plain arrays: executors need no class of ours
    indexed = good.mapInArrow(_index_batches(shared), VECTORS)
    routed = asked.mapInArrow(_query_batches(shared, probes), QUERIES)
    near = indexed.groupBy("cell").cogroup(routed.groupBy("cell")).applyInArrow(_search_cell(shared, k, rerank), NEAR)
    # one shuffle serves both the best of a pair and the best of a query
    best = near.repartition("query_id").groupBy("query_id", "chunk_id").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "chunk_id")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def exact(vectors: DataFrame, dims: int, ids: DataFrame, k: int = K, block: int = 512) -> DataFrame:
    """The same by comparing everything with everything; for measuring recall.

    All ids are answered, about 5,000 at a time against the stream of all vectors.
    """
    wanted = ids.select("chunk_id").distinct()
    parts = max(1, -(-wanted.count() // EXACT_IDS))
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(parts))
    near = [_exact_part(vectors, dims, wanted.where(part == i), k, block) for i in range(parts)]
    best = reduce(DataFrame.unionByName, near).groupBy("query_id", "chunk_id").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "chunk_id")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _exact_part(vectors: DataFrame, dims: int, ids: DataFrame, k: int, block: int) -> DataFrame:
    """Candidates of so many ids as the driver can hold."""
    good = usable(vectors, dims)
    wanted = good.join(F.broadcast(ids), "chunk_id", "left_semi").dropDuplicates(["chunk_id"]).toArrow()
    names, q = wanted.column(0).to_pylist(), _matrix(wanted.column(1), dims)
    shared = vectors.sparkSession.sparkContext.broadcast((np.array(names, object), q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_names, q_all = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids_ = _matrix(batch.column(1), dims), np.array(batch.column(0).to_pylist(), object)
            for i in range(0, len(q_all), block):
                s = q_all[i : i + block] @ x.T
                s[q_names[i : i + block, None] == ids_[None, :]] = -2
                top = np.argsort(-s, axis=1, kind="stable")[:, : k + 20]
                v = np.take_along_axis(s, top, 1)
                rows = np.repeat(np.arange(i, i + len(s)), top.shape[1])
                ok = v.ravel() > -2
                yield pa.RecordBatch.from_arrays([pa.array(q_names[rows[ok]], pa.string()), pa.array(ids_[top.ravel()[ok]], pa.string()), pa.array(v.ravel()[ok].astype(np.float64))], names=NEAR.names)

    return good.mapInArrow(run, NEAR)


def pairs(near: DataFrame) -> DataFrame:
    """``chunk_id_a, chunk_id_b``, the smaller id first, each pair once."""
    a, b = F.least("query_id", "chunk_id"), F.greatest("query_id", "chunk_id")
    return near.select(a.alias("chunk_id_a"), b.alias("chunk_id_b")).distinct()
