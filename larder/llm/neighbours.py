"""Operator 8: approximate nearest neighbours by balanced posting lists.

Fitting. ``SAMPLE`` vectors at most (the smallest by hash of their id; documented
bound) are split in two again and again along their main direction, at the median, so
that all lists get equal shares; the means of the parts are the centroids. Their
number grows with the table, up to ``MOST_LISTS``, so that what the workers hold
(centroids and their neighbour graph) has a fixed bound; beyond it lists grow and are
cut into more blocks.

Indexing. Every vector goes to the list of its nearest centroid, and as a boundary
vector also to each list whose centroid is within ``REPLICATE`` times that distance,
``REPLICAS`` at most. Centroids are found by best-first search in the in-memory graph
of their nearest neighbours. A list is dealt out to blocks of about ``BLOCK`` rows by a
hash of the vector's id, so a list with a third of all vectors (one very common vector)
is many tasks' work.

Searching. A query selects the lists within ``PROBE`` times the distance of the
nearest centroid, ``PROBES`` at most, and is sent to all their blocks; each block
returns its own ``k`` nearest by exact cosine, and the best ``k`` of all stay.

Cases: vectors that are null, zero or hold null or non-finite components, or are not of
the most common length, take no part, neither do rows without an id. Ties go to the smaller vec_id.
Rows that repeat a vec_id count once: of several vectors of a query's or a candidate's id the nearest pair
is its score. None of a query's own vec_id is its neighbour. With fewer candidates than k, a query has fewer rows. Recall against brute
force is measured in tests/llm (0.9 at least is asked for).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import stage

SAMPLE = 40_000
LIST = 400
MOST_LISTS = 16_384
REPLICATE, REPLICAS = 1.10, 4
PROBE, PROBES = 1.30, 32
BLOCK = 2_000
DEGREE = 16
BEAM = 48


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that tiny and huge ones neither vanish nor overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def balanced(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of equal parts of sample (unit rows): parts are halved along their main direction."""
    parts = [np.arange(len(sample))]
    while len(parts) < lists:
        parts.sort(key=len)
        big = parts.pop()
        if len(big) < 2:
            parts.append(big)
            break
        x = sample[big] - sample[big].mean(axis=0)
        d = x[np.argmax((x * x).sum(axis=1))]
        for _ in range(6):
            d = x.T @ (x @ d)
            if not (size := np.sqrt(d @ d)) > 0:
                break
            d = d / size
        order = np.argsort(x @ d, kind="stable")
        parts += [big[order[: len(big) // 2]], big[order[len(big) // 2 :]]]
    means = np.array([sample[p].mean(axis=0) for p in parts])
    return means[np.lexsort(means.T[::-1])]


class Graph:
    """Centroids with links to their nearest ones, searched best first for many rows at a time."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        n = len(centroids)
        sq = (centroids * centroids).sum(axis=1)
        self.sq = sq
        degree = min(DEGREE, n)
        near = np.empty((n, degree), np.int64)
        for i in range(0, n, 1024):
            d = sq[None] - 2 * centroids[i : i + 1024] @ centroids.T
            near[i : i + 1024] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        # some far links keep the graph in one piece
        self.links = np.hstack([near, np.random.default_rng(0).integers(0, n, (n, 4)), (np.arange(n)[:, None] + 1) % n])
        self.starts = np.unique(np.linspace(0, n - 1, min(n, 24)).astype(np.int64))

    def distances(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each row to its own centroids at (a row of numbers each); rows have length 1."""
        d = 1 + self.sq[at] - 2 * np.einsum("bd,bkd->bk", rows, self.c[at])
        return np.sqrt(np.maximum(d, 0))

    def search(self, rows: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """For each row up to beam centroids, nearest first, with their distances (inf: none)."""
        b, n = len(rows), len(self.c)
        beam = min(beam, n)
        seen = np.zeros((b, n), bool)
        ids = np.tile(self.starts, (b, 1))
        seen[:, self.starts] = True
        dist = self.distances(rows, ids)
        done = np.zeros(ids.shape, bool)
        own = np.arange(b)
        while True:
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, done = (np.take_along_axis(x, order, 1) for x in (ids, dist, done))
            open_ = np.where(done, np.inf, dist)
            pick = open_.argmin(axis=1)
            if not np.isfinite(open_[own, pick]).any():
                return ids, dist
            done[own, pick] = True
            new = self.links[ids[own, pick]]
            known = seen[own[:, None], new]
            seen[own[:, None], new] = True
            first = np.ones(new.shape, bool)
            for k in range(1, new.shape[1]):
                first[:, k] = (new[:, :k] != new[:, k : k + 1]).all(axis=1)
            d = np.where(known | ~first, np.inf, self.distances(rows, new))
            ids, dist, done = np.hstack([ids, new]), np.hstack([dist, d]), np.hstack([done, ~np.isfinite(d)])


def lists_of(df: DataFrame, shared, ratio: float, most: int, names: tuple) -> DataFrame:
    """df (vec_id, v) with a row for each list within ratio times the nearest distance: names = (id, vector, list)."""

    def run(batches):
        graph: Graph = shared.value
        step = max(1, min(4096, (16 << 20) // len(graph.c)))
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(ids), -1)
            for i in range(0, len(ids), step):
                at, dist = graph.search(unit(rows[i : i + step]))
                at, dist = at[:, :most], dist[:, :most]
                row, col = np.nonzero(dist <= ratio * dist[:, :1] + 1e-12)
                v = pa.array(list(rows[i : i + step][row]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + step][row]), v, pa.array(at[row, col].astype(np.int32))], list(names))

    return df.mapInArrow(run, f"{names[0]} long, {names[1]} array<double>, {names[2]} int")


def fit(vectors: DataFrame, n: int) -> Graph:
    """Centroids and graph for n vectors (vec_id, v), from a sample."""
    share = min(1.0, SAMPLE / n * 0.95)
    chosen = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) if share < 1 else F.lit(True))
    rows = chosen.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    sample = unit(np.array(rows.tolist(), np.float64))
    return Graph(balanced(sample, int(min(MOST_LISTS, max(1, n // LIST), len(sample)))))


def nearest(ids: np.ndarray, rows: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest ids of rows to query by cosine, not counting query_id; equal rows have exactly equal scores."""
    dots = (rows * query).sum(axis=1)
    sizes = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum())
    with np.errstate(all="ignore"):
        score = dots / sizes
    odd = ~(np.isfinite(score) & (sizes > 1e-290))
    if odd.any():
        score[odd] = (unit(rows[odd]) * unit(query[None])).sum(axis=1)
    score[ids == query_id] = -np.inf
    order = np.lexsort((ids, -score))
    if len(np.unique(ids[order[:k]])) < min(k, len(order)):  # ids with several vectors
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
    order = order[:k]
    order = order[ids[order] != query_id]
    return ids[order], score[order]


FOUND = "query_id long, vec_id long, score double"


def search(df: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of df to each row that is_query (a column of vec_id) marks."""
    every = usable(df, vec_id, vector)
    sizes = every.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = every.where(F.size("v") == sizes["size"])
    shared = df.sparkSession.sparkContext.broadcast(fit(vectors, sizes.n))
    posted = stage(lists_of(vectors, shared, REPLICATE, REPLICAS, ("vec_id", "v", "list")), "postings")
    blocks = posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = stage(blocks, "blocks")
    dealt = posted.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))  # MOST_LISTS rows at most
    probes = lists_of(vectors.where(is_query), shared, PROBE, PROBES, ("query_id", "q", "list"))
    probes = probes.join(F.broadcast(blocks), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def best(postings: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(postings) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids, rows = postings["vec_id"].to_numpy(), np.array(postings["v"].tolist(), np.float64)
        out = [(q, *nearest(ids, rows, q, np.asarray(v, np.float64), k)) for q, v in zip(queries["query_id"], queries["q"])]
        return pd.DataFrame({"query_id": np.repeat([q for q, _, _ in out], [len(i) for _, i, _ in out]), "vec_id": np.concatenate([i for _, i, _ in out]), "score": np.concatenate([s for _, _, s in out])})

    met = dealt.select("list", "block", "vec_id", "v").groupBy("list", "block").cogroup(probes.select("list", "block", "query_id", "q").groupBy("list", "block"))
    # of an id with several vectors, as query or as candidate, the nearest pair counts
    found = met.applyInPandas(best, FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


QUERIES = {"op8_neighbours": op8_neighbours}
