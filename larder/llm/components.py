"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is two joins and two aggregations over the links that are left, which no
round makes more of; the number of rounds grows with the logarithm of the longest
chain. Links and labels stay in Spark: only a count and a checksum of each round
reach the driver. Rounds are written to the shared folder, so that a lost executor
costs no more than a part of one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .staging import stage

MAX_ROUNDS = 60


def _written(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a written table, and their count and checksum as they were written."""
    seen = Observation()
    told = links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    return stage(told, "links"), (seen.get["n"], seen.get["s"])


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the node's smallest neighbour (or itself)."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = links.select(F.inline(ways))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    moved = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, move to the smallest one."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.withColumnRenamed("a", "n"), F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b): the smallest node that it is connected with. Roots have no row.

    links should be a written table: the first round reads it more than once.
    """
    now, before = links.select("a", "b").where("a <> b"), None
    for _ in range(MAX_ROUNDS):
        now, state = _written(_small_star(_large_star(now)))
        if not state[0] or state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError(f"not settled after {MAX_ROUNDS} rounds")
