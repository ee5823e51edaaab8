"""Centroid clustering of integer vectors with Elkan's bounds.

Vectors become integers, so distances and means are exact and ties are real ones. Each vector carries its
centroid, an upper bound of its distance to that and a lower bound to every centroid. When centroids
move, the bounds move with them by the length of the move. A distance is computed only where neither the
lower bound nor half the distance between two centroids shows that the other one is strictly further.
Bounds are rounded to the safe side, and only strictly greater ones prune, so a tie always reaches the
exact comparison, in which the smaller number wins.

A round is one pass over a table in the shared folder, which reads the vectors with their bounds and writes
them with the new ones; sums of clusters are aggregated from what was written, task by task before the
shuffle. The driver sees the centroids, k rows, and no vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.core.scratch import Scratch
from webloom.llm.memory import tidy

#: Components are SCALE times a value, rounded down, and take part up to LARGEST: then distances fit 64 bits.
SCALE, LARGEST = 256, 1 << 26
#: Rounding allowance of the bounds, many times what a square root and a sum of doubles can be off.
UP, DOWN = 1 + 1e-12, 1 - 1e-12
#: Vectors handled at a time.
ROWS = 8192


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors (rows) to a centroid or to one for each."""
    d = x - centre
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """k centroids with half their distances, rounded down, and how far each moved, rounded up."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at = at
        self.half = np.stack([np.sqrt(squared(at, c).astype(np.float64)) for c in at]) * (0.5 * DOWN)
        self.moved = None if before is None else np.sqrt(squared(at - before, np.zeros_like(at[0])).astype(np.float64)) * UP

    def assign(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New (centroid, upper, lower) of vectors, from those that held before the centroids moved."""
        a, k = a.astype(np.int64), len(self.at)
        if self.moved is not None:
            upper = (upper + self.moved[a]) * UP
            lower = np.maximum(lower - self.moved[None, :], 0.0) * DOWN
        other = np.arange(k)[None, :] != a[:, None]
        rows = np.flatnonzero((other & (upper[:, None] >= lower) & (upper[:, None] >= self.half[a])).any(axis=1))
        if len(rows):
            mine, of, near = x[rows], a[rows], lower[rows]
            best = squared(mine, self.at[of])
            root = np.sqrt(best.astype(np.float64))
            high = root * UP
            near[np.arange(len(rows)), of] = root * DOWN
            for c in range(k):
                now = np.flatnonzero((of != c) & (high >= near[:, c]) & (high >= self.half[of, c]))
                if not len(now):
                    continue
                d = squared(mine[now], self.at[c])
                near[now, c] = np.sqrt(d.astype(np.float64)) * DOWN
                better = (d < best[now]) | ((d == best[now]) & (c < of[now]))
                best[now[better]], of[now[better]] = d[better], c
                high[now[better]] = np.sqrt(d[better].astype(np.float64)) * UP
            a[rows], upper[rows], lower[rows] = of, high, near
        return a, upper, lower


def _scaled(embedding: Column, dims: int) -> tuple[Column, Column]:
    """Whether a vector takes part in clustering at all, and its integer components as doubles."""
    wide = embedding.cast("array<double>")
    whole = (F.size(wide) == dims) & F.forall(wide, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    return F.coalesce(whole, F.lit(False)), wide


def integer_vectors(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that have `dims` components, none null or not finite; v is null where a
    component is beyond LARGEST."""
    keep, wide = _scaled(F.col(f"`{vector_col}`"), dims)
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), wide.alias("x"), keep.alias("keep")).where("keep").select("id", "x")
    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("v", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(SCALE * b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            within = (np.abs(x) <= LARGEST).all(axis=1)
            ends = pa.array(np.arange(0, (len(x) + 1) * dims, dims, dtype=np.int32))
            values = pa.array(np.where(within[:, None], x, 0).astype(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, values, mask=pa.array(~within))], names=["id", "v"])

    return rows.mapInArrow(tidy(run), schema)


def _matrix(lists: pa.Array, width: int, kind: type) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def _round(table: DataFrame, centroids: Centroids, first: bool, last: bool, dims: int) -> DataFrame:
    """One pass: (id, v, cluster, upper, lower) with new bounds, or (id, cluster, distance) when `last`."""
    shared, k = table.sparkSession.sparkContext.broadcast(centroids), len(centroids.at)
    whole, real = T.IntegerType(), T.FloatType()
    added = {"cluster": whole, "distance": T.LongType()} if last else {"v": T.ArrayType(whole), "cluster": whole, "upper": T.DoubleType(), "lower": T.ArrayType(real)}
    schema = T.StructType([table.schema["id"], *(T.StructField(n, t) for n, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                b = batch.slice(at, ROWS)
                x = _matrix(b.column("v"), dims, np.int64)
                if first:
                    a, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros((len(x), k))
                else:
                    a, upper, lower = b.column("cluster").to_numpy(), b.column("upper").to_numpy().copy(), _matrix(b.column("lower"), k, np.float64)
                a, upper, lower = shared.value.assign(x, a, upper, lower)
                if last:
                    out = [pa.array(a.astype(np.int32)), pa.array(squared(x, shared.value.at[a]))]
                else:
                    low = lower.astype(np.float32)
                    low = np.where(low > lower, np.nextafter(low, np.float32(0)), low)
                    ends = pa.array(np.arange(0, (len(x) + 1) * k, k, dtype=np.int32))
                    out = [b.column("v"), pa.array(a.astype(np.int32)), pa.array(upper), pa.ListArray.from_arrays(ends, pa.array(low.ravel()))]
                yield pa.RecordBatch.from_arrays([b.column("id"), *out], names=[f.name for f in schema])

    return table.mapInArrow(tidy(run), schema)


def _moved(state: DataFrame, at: np.ndarray) -> np.ndarray:
    """Exact means, rounded down, of the clusters' vectors; a cluster without any stays where it is."""
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("v")[i].cast("long")) for i in range(at.shape[1])]).alias("sums"))
    out = at.copy()
    for r in sums.collect():  # k rows at most
        out[r.cluster] = np.array(r.sums, np.int64) // r.n
    return out


def first_centroids(table: DataFrame, k: int, salt: int) -> np.ndarray:
    """The k vectors whose hashed id comes first; rows of one id by their components, null ids never."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    rows = table.where("id is not null").select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, salt: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: (id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Kept are vectors with exactly `dims` components, none null or not finite. distance is the squared one, of
    integers, to the final centroid; cluster_inertia and inertia add it up over the cluster and over all;
    centroid_sha256 is the digest of the final centroid's components, joined by commas. With fewer than k
    kept vectors with an id there are as many centroids as those. Null ids are clustered like any other, but
    are no first centroid; without any id all columns but the id are null. Repeated rows count each, and so
    do rows that share an id. Of centroids at equal distance the smaller number wins. A vector with a
    component beyond LARGEST, whose distances would not fit 64 bits, is returned with nulls and moves no
    centroid. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "elkan")
    table = scratch.write(integer_vectors(vectors, dims, id_col, vector_col), "vectors")
    inside = table.where("v is not null")
    at = first_centroids(inside, k, salt)
    columns = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
    left = (table.where("v is null") if len(at) else table).select("id", *[F.lit(None).cast(t).alias(c) for c, t in columns.items()])
    if not len(at):
        return left.withColumnRenamed("id", id_col)
    state, centroids = inside, Centroids(at)
    for i in range(rounds):
        state = scratch.write(_round(state, centroids, i == 0, False, dims), f"round{i}")
        new = _moved(state, at)
        scratch.drop(*([f"round{i - 1}"] if i else []))
        centroids, at = Centroids(new, at), new
        if not centroids.moved.any():
            break  # whatever follows gives the same
    done = scratch.write(_round(state, centroids, rounds == 0, True, dims), "done")
    per_cluster = done.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # k rows at most
    total = sum(r.s for r in per_cluster)
    told = [(r.cluster, r.s, total, hashlib.sha256(",".join(map(str, at[r.cluster].tolist())).encode()).hexdigest()) for r in per_cluster]
    of_cluster = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = done.join(F.broadcast(of_cluster), "cluster")  # k rows
    return out.select("id", *columns).union(left).withColumnRenamed("id", id_col)
