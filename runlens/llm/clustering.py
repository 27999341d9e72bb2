"""Centroid clustering over a vector approximation file.

Vectors of integers are written twice: whole, and as a few bits for each
component that name the cell it falls in. Cells are bounded by quantiles over
all vectors, the outermost by the least and greatest component. For each
dimension, cell and centroid a table has the least and the greatest squared
difference, so their sums over the dimensions bound a vector's distance to each
centroid. Only where the intervals of several centroids overlap, or where a
vector changes its cluster, the whole vector is fetched, and told by its exact
distance to the centroids left.

Sums of the clusters are kept and only corrected by the vectors that move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import SLICE, materialize

DIMENSIONS = 64
CLUSTERS, ROUNDS, SCALE = 16, 3, 64
#: Bits of a cell's number.
BITS = 5
#: Components are cut to this size: a squared distance then fits into a long.
MOST = 1 << 27


def keep_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """key, vec_id and the integers q of the vectors with exactly DIMENSIONS components, none null or non-finite, as a table."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.coalesce((F.size(v) == DIMENSIONS) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    q = F.transform(v, lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x * SCALE, F.lit(-2.0 * MOST)), F.lit(2.0 * MOST))), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    return materialize(vectors.where(sound).select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("vec_id"), q.alias("q")), "vectors")


def first_centroids(kept: DataFrame, clusters: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids; equal hashes by the vector."""
    chosen = kept.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("hash"), "q")
    return np.array([r.q for r in chosen.orderBy(F.asc_nulls_last("hash"), "q").limit(clusters).collect()], np.int64).reshape(-1, DIMENSIONS)


def cell_bounds(kept: DataFrame, bits: int) -> np.ndarray:
    """For each dimension the least component of every cell, and after them the greatest component plus 1; cells may be empty."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    long = kept.select(F.posexplode("q").alias("d", "x"))
    found = long.groupBy("d").agg(F.min("x").alias("low"), F.percentile_approx("x", shares, 1000).alias("inner"), (F.max("x") + 1).alias("high")).collect()  # a row for each dimension
    return np.array([sorted([r.low, *r.inner, r.high]) for r in sorted(found)], np.int64)


def cells_of(q: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The cell of each component of the vectors."""
    return np.stack([np.searchsorted(b[1:-1], q[:, d], "right") for d, b in enumerate(bounds)], 1).astype(np.uint8)


def distance_tables(bounds: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """dimension x cell x centroid: least and greatest squared difference of a component in the cell."""
    low, high = bounds[:, :-1, None], np.maximum(bounds[:, 1:, None] - 1, bounds[:, :-1, None])
    c = centroids.T[:, None, :]
    near = np.maximum(np.maximum(low - c, c - high), 0)
    far = np.maximum(np.abs(c - low), np.abs(c - high))
    return near * near, far * far


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(-1, DIMENSIONS)


def _cell_batches(batches: Iterator[pa.RecordBatch], bounds: Broadcast) -> Iterator[pa.RecordBatch]:
    """(key, q) -> key and the cells as bytes."""
    for batch in batches:
        cells = cells_of(_matrix(batch.column(1), np.int64), bounds.value)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in cells], pa.binary())], names=["key", "cells"])


def _bound_batches(batches: Iterator[pa.RecordBatch], tables: Broadcast) -> Iterator[pa.RecordBatch]:
    """(key, cluster, cells) -> key, cluster and left: the centroids that may be nearest, as bits."""
    near, far = tables.value
    dims = np.arange(DIMENSIONS)
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            batch = whole.slice(start, SLICE)
            cells = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, DIMENSIONS)
            least = near[dims, cells].sum(1)
            most = far[dims, cells].sum(1)
            # an equal distance of a smaller number wins, so equal bounds stay open
            maybe = least <= most.min(1, keepdims=True)
            left = (maybe.astype(np.int64) << np.arange(maybe.shape[1])).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(left, pa.int64())], names=["key", "cluster", "left"])


def _assign(q: np.ndarray, left: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the centroids left for each vector (ties: the smaller number), and its squared distance."""
    best, cluster = np.full(len(q), np.iinfo(np.int64).max), np.zeros(len(q), np.int64)
    for i, c in enumerate(centroids):
        rows = np.flatnonzero(left >> i & 1)
        d = q[rows] - c
        d = np.einsum("ij,ij->i", d, d)
        nearer = d < best[rows]
        best[rows[nearer]], cluster[rows[nearer]] = d[nearer], i
    return cluster, best


def _exact_batches(batches: Iterator[pa.RecordBatch], centroids: Broadcast) -> Iterator[pa.RecordBatch]:
    """(key, cluster, left, q, ...) -> key, the cluster before and now, the distance, and q."""
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            batch = whole.slice(start, SLICE)
            cluster, distance = _assign(_matrix(batch.column(3), np.int64), batch.column(2).to_numpy(), centroids.value)
            columns = [batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "before", "cluster", "distance", "q"])


def _move_batches(batches: Iterator[pa.RecordBatch], clusters: int) -> Iterator[pa.RecordBatch]:
    """(before, cluster, q) -> for each cluster that rows enter or leave: number of rows and sums, of a task's rows at once."""
    n, sums = np.zeros(clusters, np.int64), np.zeros((clusters, DIMENSIONS), np.int64)
    for batch in batches:
        q = _matrix(batch.column(2), np.int64)
        for sign, of in ((1, batch.column(1).to_numpy()), (-1, batch.column(0).to_numpy())):
            for c in np.unique(of[of >= 0]):
                n[c] += sign * int((of == c).sum())
                sums[c] += sign * q[of == c].sum(0)
    at = np.flatnonzero((n != 0) | sums.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array([s.tolist() for s in sums[at]], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])


def bits_of(left: str) -> Column:
    """The only centroid left, or null where several are."""
    one = F.expr(f"bit_count({left}) = 1")
    return F.when(one, F.round(F.log2(left)).cast("int"))


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, bits: int = BITS) -> DataFrame:
    """One row per kept row: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Rows whose vector is null or has other than DIMENSIONS components, or one
    that is null or not finite, are left out. A null id is kept, and begins a
    cluster only where ids are too few. Repeated rows each count and get a row.
    With fewer rows than clusters there are as many centroids as rows; an empty
    table gives an empty result. Components beyond 2**27 are cut to that.
    Further columns are left out.
    """
    spark = vectors.sparkSession
    share = spark.sparkContext.broadcast
    kept = keep_vectors(vectors, id_col, vector_col)
    centroids = first_centroids(kept, min(clusters, 62))
    result = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], result)
    k = len(centroids)
    bounds = cell_bounds(kept, bits)
    cells = materialize(kept.select("key", "q").mapInArrow(partial(_cell_batches, bounds=share(bounds)), "key long, cells binary"), "cells")
    count, sums = np.zeros(k, np.int64), np.zeros((k, DIMENSIONS), np.int64)
    state = cells.select("key", F.lit(-1).alias("cluster"))
    for step in range(rounds + 1):
        last = step == rounds
        known = cells.select("key", F.lit(-1).alias("cluster"), "cells") if step == 0 else state.hint("merge").join(cells, "key").select("key", "cluster", "cells")
        judged = materialize(known.mapInArrow(partial(_bound_batches, tables=share(distance_tables(bounds, centroids))), "key long, cluster int, left long"), "judged")
        told = bits_of("left")
        # the distances of the last assignment need every vector; before, only those in doubt or on the move do
        fetch = F.lit(True) if last else told.isNull() | (told != F.col("cluster"))
        fetched = judged.where(fetch).hint("merge").join(kept.select("key", "q"), "key").select("key", "cluster", "left", "q")
        exact = fetched.mapInArrow(partial(_exact_batches, centroids=share(centroids)), "key long, before int, cluster int, distance long, q array<int>")
        if last:
            final = materialize(exact.select("key", "cluster", "distance"), "assigned")
            break
        exact = materialize(exact.where("before <> cluster").select("key", "before", "cluster", "q") if step else exact.select("key", "before", "cluster", "q"), "moved")
        moves = exact.select("before", "cluster", "q").mapInArrow(partial(_move_batches, clusters=k), "cluster int, n long, sums array<long>")
        moves = moves.select("cluster", "n", F.posexplode("sums").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        for r in moves.collect():  # at most clusters x DIMENSIONS rows
            sums[r.cluster, r.d] += r.x
            if r.d == 0:
                count[r.cluster] += r.n
        centroids = np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], centroids)
        stayed = judged.select("key", F.col("cluster").alias("old")).hint("merge").join(exact.select("key", "cluster"), "key", "left")
        state = materialize(stayed.select("key", F.coalesce("cluster", "old").alias("cluster")), "clusters")

    inertia = {r.cluster: int(r.x) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}  # a row for each cluster
    by_cluster = lambda values, kind: F.array(*(F.lit(v).cast(kind) for v in values))[F.col("cluster")]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    out = kept.select("key", "vec_id").hint("merge").join(final, "key")
    return out.select(
        "vec_id", "cluster", "distance", by_cluster([inertia.get(c, 0) for c in range(k)], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), by_cluster(digests, "string").alias("centroid_sha256"),
    )


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same rows for ids that are not repeated, by comparing every vector with every centroid."""
    parts = [
        f"kept as (select vec_id, [cast(floor({SCALE} * x::double) as bigint) for x in embedding] as q from embeddings where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"long as (select vec_id, unnest(range({DIMENSIONS})) as d, unnest(q) as x from kept)",
        f"starts as (select vec_id, row_number() over (order by sha256('1:' || vec_id)) - 1 as c from kept qualify c < {clusters})",
        "c0 as (select c, d, x from starts join long using (vec_id))",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} as (select vec_id, c, sum((long.x - c{i}.x) * (long.x - c{i}.x))::bigint as distance from long join c{i} using (d) group by vec_id, c)")
        parts.append(f"a{i} as (select vec_id, c, distance from d{i} qualify row_number() over (partition by vec_id order by distance, c) = 1)")
        if i < rounds:
            parts.append(f"m{i} as (select c, d, sum(x)::bigint as s, count(*) as n from long join a{i} using (vec_id) group by c, d)")
            parts.append(f"c{i + 1} as (select c{i}.c, c{i}.d, case when n is null then c{i}.x else (s - ((s % n) + n) % n) // n end as x from c{i} left join m{i} using (c, d))")
    parts.append(f"named as (select c, sha256(string_agg(x::varchar, ',' order by d)) as digest from c{rounds} group by c)")
    return f"""with {", ".join(parts)}
select vec_id, c::int as cluster, distance, (sum(distance) over (partition by c))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, digest as centroid_sha256
from a{rounds} join named using (c)"""
