"""Operator 12: exact k-means on integer vectors, with a vector-approximation file.

Every vector is written once to a staged table beside its approximation: each dimension has
``2 ** bits`` cells, and a vector keeps the number of its cell in each, one byte a dimension.
A round turns the centroids into two lookup tables (by centroid, dimension, cell) of the least
and the largest squared difference that a component in that cell can have. Sums of looked-up numbers
are bounds of the squared distance to each centroid; a vector whose intervals do not overlap is
assigned by its cells alone. Only where the interval of another centroid meets that of the best one is the full
vector fetched from its row, and only for those centroids an exact distance is made. The new mean needs each
vector once more, as any exact mean does. All arithmetic is on integers, so that results do not depend
on how Spark deals out the rows.

The full vector stands in the row of its approximation, since fetching it by a join
would shuffle the table in each round to save a part of one scan. A round is one scan without
a shuffle but that of at most k partial sums of each partition; only k centroids
reach the driver and go out to the workers (k x dimensions numbers, whatever the table's size).

Cells are cut by the density of the ``SAMPLE`` rows of smallest hash (documented bound; it decides how
tight the bounds are, not what they give); the outermost cells end at each dimension's least and largest value of all rows.

Cases: vectors that are null, hold null or non-finite components or are not of exactly
``dimensions`` components take no part. Components saturate at +-2**27, so that every squared
distance fits a long (65 dimensions at most would; more raise an error). Repeated rows are rows of their own; equal
hashes (a vec_id with several vectors) are ordered by vector. With fewer than k rows there are as
many centroids as rows; an empty table gives no rows. Ties go to the smaller number. A null vec_id
hashes like an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import column
from .staging import stage

K, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1
BITS = 6
SAMPLE = 4_096
LARGEST = 1 << 27
#: Vectors that a worker looks at together.
STEP = 2_048


def quantized(df: DataFrame, vec_id: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v array<int>) of the vectors that take part: floor(scale * x) of each component."""
    x = column(vector).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = df.where((F.size(x) == dimensions) & F.coalesce(fine, F.lit(False)))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c * F.lit(float(scale)))))
    return kept.select(column(vec_id).cast("long").alias("vec_id"), F.transform(whole, lambda c: F.floor(c).cast("int")).alias("v"))


def order(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def _edges(values: np.ndarray, least: int, most: int, n: int) -> np.ndarray:
    """n - 1 inner edges of the cells of a dimension: cells are the wider the rarer their values (by the root of density)."""
    if most - least < n:
        return np.minimum(least + np.arange(n - 1), most)
    grid = np.linspace(least, most, 16 * n + 1)
    share = np.sqrt(np.diff(np.searchsorted(values, grid)) + 0.25)
    sums = np.concatenate([[0], np.cumsum(share)])
    return np.floor(np.interp(sums[-1] * np.arange(1, n) / n, sums, grid)).astype(np.int64)


class Cells:
    """Cells of each dimension: edges[d] are the largest values of all cells but the last, low and high their true ends."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int):
        n = 1 << bits
        self.edges = np.array([_edges(np.sort(sample[:, d]), int(least[d]), int(most[d]), n) for d in range(sample.shape[1])], np.int64)
        self.low = np.hstack([least[:, None], self.edges + 1])
        self.high = np.hstack([self.edges, most[:, None]])
        self.low, self.high = np.minimum(self.low, most[:, None]), np.maximum(self.high, least[:, None])

    def of(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, rows[:, d], side="left") for d, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared difference by dimension, cell and centroid."""
        c = centroids.T[:, None, :]
        below, above = self.low[:, :, None] - c, c - self.high[:, :, None]
        near = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(np.abs(below), np.abs(above))
        return near * near, far * far


def assign(cells: np.ndarray, vectors: np.ndarray, near: np.ndarray, far: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, number of exact distances made) of rows given by their cells; vectors are looked at only where intervals overlap."""
    least = np.zeros((len(cells), len(centroids)), np.int64)
    most = np.zeros_like(least)
    for d in range(cells.shape[1]):
        least += near[d][cells[:, d]]
        most += far[d][cells[:, d]]
    open_ = least <= most.min(axis=1)[:, None]
    made = open_.sum(axis=1)
    cluster = open_.argmax(axis=1)
    rows = np.flatnonzero(made > 1)
    if len(rows):
        exact = np.full((len(rows), len(centroids)), np.iinfo(np.int64).max)
        at, which = np.nonzero(open_[rows])
        for i in range(0, len(at), 8 * STEP):
            a, w = at[i : i + 8 * STEP], which[i : i + 8 * STEP]
            exact[a, w] = distances(vectors[rows[a]], centroids[w])
        cluster[rows] = exact.argmin(axis=1)
    return cluster, np.where(made > 1, made, 0)


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    apart = rows.astype(np.int64) - centroids
    return (apart * apart).sum(axis=1)


def _blocks(batches, dimensions: int):
    """(ids, cells, vectors) of the staged rows, STEP at a time; the vectors are a view of the batch, not a copy."""
    for batch in batches:
        for i in range(0, batch.num_rows, STEP):
            part = batch.slice(i, STEP)
            yield part.column(0), *[np.frombuffer(b"".join(part.column(c).to_pylist()), kind).reshape(-1, dimensions) for c, kind in ((1, np.uint8), (2, np.int32))]


def approximated(vectors: DataFrame, cells: Cells, dimensions: int) -> DataFrame:
    """(vec_id, cells binary, v binary): the vector-approximation file."""

    def run(batches):
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int32)
            both = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (cells.of(rows), rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *both], ["vec_id", "cells", "v"])

    return vectors.mapInArrow(run, "vec_id long, cells binary, v binary")


def sums(table: DataFrame, cells: Cells, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of each cluster that has vectors: k rows at most."""
    dimensions = centroids.shape[1]

    def run(batches):
        near, far = cells.tables(centroids)
        counts, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, approximations, vectors in _blocks(batches, dimensions):
            cluster, _ = assign(approximations, vectors, near, far, centroids)
            counts += np.bincount(cluster, minlength=len(centroids))
            by = np.argsort(cluster, kind="stable")
            starts = np.flatnonzero(np.diff(cluster[by], prepend=-1))
            total[cluster[by][starts]] += np.add.reduceat(vectors[by], starts, axis=0, dtype=np.int64)
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(counts[has]), pa.array(total[has].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = table.mapInArrow(run, "cluster int, n long, total array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[d]) for d in range(dimensions)]).alias("total"))
    return {r.cluster: (r.n, r.total) for r in added.collect()}


def clusters(
    df: DataFrame, k: int = K, rounds: int = ROUNDS, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, bits: int = BITS
) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance, fetched), centroids): fetched counts the exact distances that the cells could not spare."""
    if not 1 <= bits <= 8 or not 1 <= dimensions <= 64:
        raise ValueError("bits go from 1 to 8, dimensions from 1 to 64")
    vectors = quantized(df, vec_id, vector, dimensions, scale)
    first = vectors.orderBy(order(seed), "v").limit(max(k, SAMPLE)).collect()  # a bounded number of rows
    if not first:
        return df.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, fetched int"), []
    centroids = np.array([r.v for r in first[:k]], np.int64)
    ends = vectors.agg(F.array(*[F.min(F.col("v")[d]) for d in range(dimensions)]).alias("low"), F.array(*[F.max(F.col("v")[d]) for d in range(dimensions)]).alias("high")).first()
    cells = Cells(np.array([r.v for r in first], np.int64), np.array(ends.low, np.int64), np.array(ends.high, np.int64), bits)
    table = stage(approximated(vectors, cells, dimensions), "approximations")
    for _ in range(rounds):
        for c, (n, total) in sums(table, cells, centroids).items():
            centroids[c] = [x // n for x in total]

    def run(batches):
        near, far = cells.tables(centroids)
        for ids, approximations, rows in _blocks(batches, dimensions):
            cluster, made = assign(approximations, rows, near, far, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distances(rows, centroids[cluster])), pa.array(made.astype(np.int32))], ["vec_id", "cluster", "distance", "fetched"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long, fetched int"), centroids.tolist()


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = stage(found, "clusters")
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    own = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("cluster_inertia"))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    whole = own.agg(F.least(F.sum("cluster_inertia"), most).cast("long").alias("inertia"))
    named = own.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster").crossJoin(whole)  # k rows beside one row
    named = named.withColumn("cluster_inertia", F.least("cluster_inertia", most).cast("long"))
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "fetched")


QUERIES = {"op12_centroids": op12_centroids}
