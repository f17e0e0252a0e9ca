"""Operator 6: SimHash near-duplicates by Golay-code fuzzy hashing.

1. One pass over the texts makes a 64-bit fingerprint each; exact copies, however many,
   then fold into one row per fingerprint, with the smallest doc_id (partial
   aggregation before the shuffle).
2. A fingerprint is cut into segments A and B of 23 bits and C of 18. Of two
   fingerprints with 2 differing bits at most, one of these holds:
   A equal and B within 1 bit; B equal and A within 1; C equal and A within 1; C equal
   and B within 1. (With C equal, A or B has 1 error at most; otherwise A and B share
   one error at most, so one of them is equal.) The segment within 1 bit gives its Golay
   keys, the other stands as it is: up to 24 keys of 30 or 35 bits a fingerprint.
3. Fingerprints of equal key are joined and verified by their bits. Keys held by more
   than ``PAIR_LIMIT`` different fingerprints give no pairs; their fingerprints meet in
   another exact way: each is spread to itself and its 64 one-bit neighbours, and all
   that reach the same neighbour (so differ in 2 bits at most) are linked to the
   smallest of them. No link is lost and no group of copies is squared.
4. Components of the link table give the smallest doc_id reachable.

Cases: null and empty texts have no word and fingerprint zero, linked like any other;
texts shorter than a shingle give one shingle of all their words. Null doc_ids take
part; a component of nulls alone has a null id. Repeated rows give repeated results.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import golay
from .columns import column, extended
from .components import components
from .staging import stage

SEED = 42
MAX_BITS = 2
PAIR_LIMIT = 32
BLOCK = 1 << 15


def shingles(text: str | None, words: int) -> list[bytes]:
    """Word shingles of the text with A-Z lowered, repeats included; bytes.split() cuts at just \\x20 and \\x09-\\x0D."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)))))


def hashes(text: str | None, words: int) -> np.ndarray:
    rows = shingles(text, words)
    return np.fromiter(map(xxhash.xxh64_intdigest, rows, repeat(SEED)), dtype=np.uint64, count=len(rows))


def fingerprint(h: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is in over half the hashes."""
    if not len(h):
        return 0
    ones = sum(np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(h), BLOCK))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, words: int = 3, text: str = "text") -> DataFrame:
    """The rows of df, without their text, with fp, the fingerprint as a signed long."""
    return extended(df, text, "fp long", lambda texts: [pa.array([fingerprint(hashes(t.as_py(), words)) for t in texts], pa.int64())], keep_text=False)


def golay_keys(fps: DataFrame) -> DataFrame:
    """(key, fp) for each of fps (fp)."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            low = fp.view(np.uint64)
            a, b, c = ((low >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18)))
            near_a, near_b = golay.keys(a), golay.keys(b)
            for family, (exact, near) in enumerate(((a, near_b), (b, near_a), (c, near_a), (c, near_b))):
                row, _ = there = np.nonzero(near >= 0)
                key = family << 56 | exact[row] << 12 | near[there]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def flip_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all of fps with 2 differing bits at most, through common one-bit neighbours."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    spread = fps.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("near"))
    least = spread.groupBy("near").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    return spread.join(least, "near").select(F.col("fp").alias("a"), "b").where("a <> b").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints of fps (fp, all different) with 2 differing bits at most."""
    keyed = golay_keys(fps)
    n = F.count("*").over(Window.partitionBy("key"))
    met = stage(keyed.withColumn("n", n).where("n > 1"), "buckets")
    few = met.where(F.col("n") <= PAIR_LIMIT)
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") > F.col("y.fp")))
    near = pairs.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MAX_BITS)
    direct = near.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    return direct.union(flip_links(met.where(F.col("n") > PAIR_LIMIT).select("fp").distinct()))


def near_duplicates(df: DataFrame, words: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) of every row of df."""
    docs = stage(fingerprints(df.select(column(doc_id).alias("doc_id"), column(text).alias("text")), words), "fingerprints")
    firsts = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(stage(links(docs.select("fp").distinct()), "pairs"))
    rooted = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = stage(rooted.join(smallest, "root").select("fp", "component_id"), "labels")
    return docs.join(labels, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
