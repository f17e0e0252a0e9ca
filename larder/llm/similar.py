"""Groups of rows whose word-shingle sets have a Jaccard similarity of at least 0.8, none lost.

Operator 6 finds what its Golay keys reach: fingerprints of few differing bits. Texts of
similarity 0.8 differ in some 10 of 64 bits, so an exact similarity join stands beside it:

1. Rows of equal shingle sets fold into one (its row of the smallest doc_id).
2. ``partners()``: of each set the shingles of one part of the hash space are counted. A
   set that has a partner shares all but 1 - t of its shingles, so those of that part
   which no other set has are that many at most; all other sets are done. Shingles travel as
   packed blocks of 32-bit rests, by which chance can only keep a set, not lose one.
3. The shingles of the sets that are left are put in one order, by the number of sets that
   have them (``levels()``), else by hash. Two similar sets meet among the first
   (1 - t) * size + 1 of each (prefix filter; any one order is right). Shingles of one set only
   meet nothing and go no further.
4. Pairs are verified by their whole shingle sets. First come the Golay links, then, for
   ``ROUNDS`` rounds, each set with the one set of another group that leads most of its
   prefix: these merge large groups with one pair a row. Then ``crossing()`` gives
   every pair of different groups that the prefixes allow, without a limit.
5. Components of the verified pairs are the groups.

No list of rows, links or shingles reaches the driver or is broadcast by us, and no
bucket is gathered in one task: buckets are joined, where AQE splits hot keys.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .components import components
from .simhash import fingerprint, hashes, links
from .staging import discard, stage

#: The part of the hash space in which partners() counts.
PART = 0.3
#: Shingles that a task sorts at a time, and that a block of the counting holds.
HELD, BLOCK = 1 << 20, 1 << 20
FREQUENT = 8
ROUNDS = 3
#: Leads of a row in a round.
LEADS = 4
#: Pairs of one set that are verified in one place.
TOGETHER = 512
NEAR = 1e-6
#: Columns of a set's marks: of each of 256 parts of the hash space, whether an odd number of its shingles is there.
MARKS = ["m0", "m1", "m2", "m3"]
NOBODY = 0xFFFFFFFF


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The set of the text's shingles as mixed 62-bit hashes, in order."""
    h = hashes(text, words) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique((h ^ h >> np.uint64(32)) >> np.uint64(2))


def counted(tokens: np.ndarray) -> np.ndarray:
    """Of a set in order, those in the part of the hash space where partners() counts."""
    return tokens[: np.searchsorted(tokens, np.uint64(int(PART * (1 << 62))))]


def first_size(size: int, similarity: float) -> int:
    """How many of a set's first shingles meet those of any similar set."""
    return size - ceil(similarity * size - NEAR) + 1 if size else 0


def sketches(df: DataFrame, words: int) -> DataFrame:
    """(rid, doc_id, same, fp, size, part): hash of the shingle set, fingerprint, set size, size of the counted part."""
    names = ["rid", "doc_id", "same", "fp", "size", "part"]

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(2):
                h = hashes(t.as_py(), words)
                own = shingle_set(t.as_py(), words)
                rows.append((xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63), fingerprint(h), len(own), len(counted(own))))
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), pa.int64()) for c in columns)], names)

    rows = df.select("rid", "doc_id", "text")
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:2], *StructType.fromDDL("same long, fp long, size long, part long").fields]))


def partners(df: DataFrame, buckets: int, words: int) -> tuple[DataFrame, DataFrame]:
    """The blocks, and from them (rid, n) of df (rid, text): how many counted shingles of the row occur in other rows, or seem to.

    A task sorts the shingles of many rows at a time and cuts them into blocks by hash. What
    repeats there is settled there, and only one of the repeated goes on, so that a shingle
    of a third of all rows comes to its block once for each HELD shingles. Counts go back
    packed to the rows' own chunk, a row of Spark for a block and not for each row in it.
    """
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    bounds = np.array([int((1 << 62) * PART / buckets * k) for k in range(1, buckets)], np.uint64)

    def blocks(rids: list[int], sets: list[np.ndarray]):
        base = min(rids)
        owner = np.repeat(np.array([r - base for r in rids], np.uint32), [len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        del order
        first = np.concatenate(([True], tokens[1:] != tokens[:-1]))
        at = np.flatnonzero(first)
        n = np.diff(np.append(at, len(tokens)))
        again = n > 1
        who, n = np.unique(owner[np.repeat(again, n)], return_counts=True)
        yield 0, base, b"", np.stack([who.astype(np.uint32), n.astype(np.uint32)]).tobytes()
        tokens, owner = tokens[at], owner[at]
        owner[again] = NOBODY
        edges = [0, *np.searchsorted(tokens, bounds).tolist(), len(tokens)]
        for bucket, (low, high) in enumerate(zip(edges[:-1], edges[1:]), 1):
            if low < high:
                yield bucket, base, tokens[low:high].astype(np.uint32).tobytes(), owner[low:high].tobytes()

    def cut(batches):
        rids, sets, held = [], [], 0
        for batch in batches:
            for rid, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = counted(shingle_set(t.as_py(), words))
                if held and (held + len(own) > HELD or not 0 <= rid - rids[0] < NOBODY):
                    yield from batches_of(blocks(rids, sets))
                    rids, sets, held = [], [], 0
                if len(own):
                    rids.append(rid), sets.append(own)
                    held += len(own)
        if held:
            yield from batches_of(blocks(rids, sets))

    def batches_of(rows):
        held: list = []
        for row in rows:
            held.append(row)
            if len(held) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], ["bucket", "base", "tokens", "rows"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], ["bucket", "base", "tokens", "rows"])

    def meet(table):
        """(base, rows): for each block of the bucket, packed, which of its chunk's rows have shared shingles there, and how many."""
        bases, rows = table.column("base").to_pylist(), [np.frombuffer(x, np.uint32) for x in table.column("rows").to_pylist()]
        rests = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("tokens").to_pylist()])
        owner = np.concatenate([np.where(r == NOBODY, -1, r.astype(np.int64) + (k << 32)) for k, r in enumerate(rows)])
        order = np.argsort(rests, kind="stable")
        rests, owner = rests[order], owner[order]
        del order
        at = np.flatnonzero(np.concatenate(([True], rests[1:] != rests[:-1])))
        n = np.diff(np.append(at, len(rests)))
        alone = np.minimum.reduceat(owner, at) >= 0  # a rest that comes settled is shared wherever it comes
        owner = owner[np.repeat((n > 1) | ~alone, n)]
        who, n = np.unique(owner[owner >= 0], return_counts=True)
        edges = np.searchsorted(who, np.arange(len(rows) + 1, dtype=np.int64) << 32)
        found = [(base, np.stack([(who[low:high] & NOBODY).astype(np.uint32), n[low:high].astype(np.uint32)]).tobytes()) for base, low, high in zip(bases, edges[:-1], edges[1:]) if low < high]
        return pa.table({"base": pa.array([b for b, _ in found], pa.int64()), "rows": pa.array([r for _, r in found], pa.binary())})

    def together(table):
        """(rid, n) of the rows of one chunk, from all of its blocks."""
        base = table.column("base")[0].as_py()
        parts = [np.frombuffer(x, np.uint32).reshape(2, -1) for x in table.column("rows").to_pylist()]
        who, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.zeros(len(who), np.int64)
        np.add.at(n, at, np.concatenate([p[1] for p in parts]).astype(np.int64))
        return pa.table({"rid": pa.array(who.astype(np.int64) + base), "n": pa.array(n)})

    packed = df.select("rid", "text").mapInArrow(cut, "bucket int, base long, tokens binary, rows binary")
    held = stage(packed, "blocks")
    apart = held.where("bucket > 0").groupBy("bucket").applyInArrow(meet, "base long, rows binary")
    every = held.where("bucket = 0").select("base", "rows").union(apart)
    return held, every.groupBy("base").applyInArrow(together, "rid long, n long")


def marks(own: np.ndarray) -> np.ndarray:
    """MARKS of a shingle set: two sets differ in at least as many shingles as in marks."""
    odd = np.bincount((own & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def levels(n: np.ndarray) -> np.ndarray:
    """How late shingles of n sets come in the one order, 0 to 63: those of one set first, each number apart up to FREQUENT, then by thirds of doublings."""
    few = max(FREQUENT, 1)
    return np.minimum(63, np.where(n <= few, n - 1, few - 1 + np.floor(3 * np.log2(np.maximum(n, few) / few)))).astype(np.uint8)


def chunk_tokens(table: pa.Table, words: int) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """Of the rows of a chunk: rids, shingle sets, and all different shingles in order with the number of sets that have each."""
    sets = [shingle_set(t.as_py(), words) for t in table.column("text")]
    return table.column("rid").to_pylist(), sets, *np.unique(np.concatenate(sets), return_counts=True)


def prefixes(texts: DataFrame, total: int, words: int, similarity: float) -> DataFrame:
    """(rid, token, size, last, own, MARKS) of texts (rid, text): those of each set's first shingles that other sets have, the set's size, the last of the first, and how many shingles of the set no other has; tokens are in their order.

    The order is by the number of sets that have a shingle (levels()), then by hash. Rows are dealt to
    chunks by their number; total is how many shingles they have. A chunk sends each of its shingles once, to the block of
    its hash, packed, and a byte each comes back. Rests of 32 bits that are equal by chance are counted
    together, for all sets alike, so that the order stays one.
    """
    buckets = max(1, ceil(total / BLOCK))
    chunks = max(ceil(total / HELD), 2 * texts.sparkSession.sparkContext.defaultParallelism)
    bounds = np.array([int((1 << 62) / buckets * k) for k in range(1, buckets)], np.uint64)
    dealt = texts.select(F.pmod(F.xxhash64("rid"), F.lit(chunks)).alias("chunk"), "rid", "text")

    def cut(table):
        _, _, tokens, n = chunk_tokens(table, words)
        edges = [0, *np.searchsorted(tokens, bounds).tolist(), len(tokens)]
        rests, n = tokens.astype(np.uint32), np.minimum(n, 0xFFFF).astype(np.uint16)
        parts = [(k, rests[low:high].tobytes(), n[low:high].tobytes()) for k, (low, high) in enumerate(zip(edges[:-1], edges[1:])) if low < high]
        bucket, packed, counts = zip(*parts) if parts else ((), (), ())
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "chunk": pa.array([table.column("chunk")[0].as_py()] * len(parts), pa.int64()), "tokens": pa.array(packed, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def meet(table):
        rests = [np.frombuffer(x, np.uint32) for x in table.column("tokens").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("counts").to_pylist()])
        _, at = np.unique(np.concatenate(rests), return_inverse=True)
        level = levels(np.bincount(at, counts))[at]
        parts = np.split(level, np.cumsum([len(r) for r in rests])[:-1])
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "levels": pa.array([x.tobytes() for x in parts], pa.binary())})

    def first(rows, back):
        out: dict = {"rid": [], "token": [], "size": [], "last": [], "own": []} | {m: [] for m in MARKS}
        if rows.num_rows and back.num_rows:
            rids, sets, tokens, _ = chunk_tokens(rows, words)
            order = np.argsort(back.column("bucket").to_numpy())
            packed = back.column("levels").to_pylist()
            level = np.frombuffer(b"".join(packed[k] for k in order), np.uint8).astype(np.int64)
            for rid, own in zip(rids, sets):
                if not len(own):
                    continue
                late = level[np.searchsorted(tokens, own)]
                placed = np.sort(late << 57 | (own >> np.uint64(5)).astype(np.int64))[: first_size(len(own), similarity)]
                shared = placed[placed >> 57 > 0]
                for name, x in (("rid", np.full(len(shared), rid, np.int64)), ("token", shared), ("size", np.full(len(shared), len(own), np.int64)), ("last", np.full(len(shared), placed[-1], np.int64)), ("own", np.full(len(shared), np.count_nonzero(late == 0), np.int64)), *((m, np.full(len(shared), x)) for m, x in zip(MARKS, marks(own)))):
                    out[name].append(x)
        return pa.table({k: pa.array(np.concatenate(v) if v else [], pa.int64()) for k, v in out.items()})

    blocks = dealt.groupBy("chunk").applyInArrow(cut, "bucket int, chunk long, tokens binary, counts binary")
    back = blocks.groupBy("bucket").applyInArrow(meet, "chunk long, bucket int, levels binary")
    return dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(first, "rid long, token long, size long, last long, own long, " + ", ".join(f"{m} long" for m in MARKS))


def crossing(met: DataFrame, similarity: float) -> DataFrame:
    """Pairs (x, y) of different roots that met (rid, token, size, last, root; own and MARKS where they are known), the prefixes, allow to be similar.

    Similar sets have at least t / (1 + t) * (|x| + |y|) shingles in common. Those of them that
    are not in both prefixes come after the prefix that ends first, so that many at
    most are left of that set. None of them is one set's own, which bounds the size of a partner
    (most). They differ in (1 - t) / (1 + t) * (|x| + |y|) shingles at most, so in as many marks: copies of
    one text, each edited elsewhere, meet in all that is left of it, and are told apart before they are pairs.
    """
    own = F.col("own") if "own" in met.columns else F.lit(0)
    bounded = met.withColumn("most", (F.col("size") - own) * (1 + similarity) / similarity - F.col("size") + NEAR)
    fits = bounded.join(met.groupBy("token").agg(F.min("size").alias("least")), "token").where("most >= least")
    several = fits.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    asked = fits.join(several, "token")
    unlike = sum((F.bit_count(F.col(f"x.{m}").bitwiseXOR(F.col(f"y.{m}"))) for m in MARKS if m in met.columns), F.lit(0))
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.rid") > F.col("y.rid"))
    sized = (F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - NEAR) & (F.col("x.most") >= F.col("y.size")) & (F.col("y.most") >= F.col("x.size"))
    sized &= unlike <= (F.col("x.size") + F.col("y.size")) * ((1 - similarity) / (1 + similarity)) + NEAR
    both = asked.alias("x").join(asked.alias("y"), apart & sized).select(F.col("x.rid").alias("x"), F.col("y.rid").alias("y"), F.col("x.size").alias("a"), F.col("y.size").alias("b"), (F.col("x.last") <= F.col("y.last")).alias("first"))
    found = both.groupBy("x", "y", "a", "b", "first").agg(F.count("*").alias("common"))
    return found.where(_enough(similarity)).select("x", "y")


def _enough(similarity: float) -> Column:
    """Whether sets of sizes a and b with that many common first shingles can be similar; first: the prefix of a's set ends first."""
    size = F.when(F.col("first"), F.col("a")).otherwise(F.col("b"))
    rest = F.ceil(similarity * size - NEAR) - 1
    return F.col("common") + rest >= similarity / (1 + similarity) * (F.col("a") + F.col("b")) - NEAR


def leads(met: DataFrame, round_: int, similarity: float) -> DataFrame:
    """Pairs (x, y): each row of met (rid, token, size, last, own, root) with the LEADS leads of other roots that most of its tokens have; a token's lead is one of its rows.

    At first that is the row with the fewest shingles of its own, which edited copies of one text are all likest
    to, then another one in every round. Pairs that cannot be similar by their sizes are left out. A
    pair's tokens with other leads are not counted, so that one that is similar may be left out too;
    crossing() has all of them.
    """
    rank = F.xxhash64("rid", F.lit(round_)) if round_ else F.col("own")
    one = met.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), "root", "rid", "size", "last")).alias("lead"))
    led = met.join(one, "token").where("root <> lead.root").select(F.col("rid").alias("x"), F.col("size").alias("a"), F.col("last").alias("last_x"), F.struct("lead.rid", "lead.size", "lead.last").alias("y"))
    counts = led.groupBy("x", "a", "last_x", "y").agg(F.count("*").alias("n"))
    fits = F.least("a", "y.size") >= similarity * F.greatest("a", "y.size") - NEAR
    pairs = counts.where(fits).select("x", "a", F.col("y.size").alias("b"), F.col("n").alias("common"), (F.col("last_x") <= F.col("y.last")).alias("first"), "y").where(_enough(similarity))
    best = pairs.groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct("common", "y.rid")), asc=False), 1, LEADS).alias("best"))
    return best.select("x", F.explode("best.rid").alias("y"))


def alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b): the pairs (x, y) whose texts (rid, text) are similar. Pairs of one y stand together, TOGETHER at most, behind y's text."""
    parts = pairs.groupBy("y").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    dealt = stage(pairs.join(parts, "y").select("x", "y", F.pmod(F.xxhash64("x"), "parts").alias("part")), "dealt")
    heads = dealt.select("y", "part").distinct().join(texts, F.col("y") == F.col("rid")).select("y", "part", F.lit(None).cast("long").alias("x"), "text")
    asked = heads.union(dealt.join(texts, F.col("x") == F.col("rid")).select("y", "part", "x", "text"))

    def run(batches):
        head, own = None, np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for y, part, x, t in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                now = shingle_set(t.as_py(), words)
                if x is None:
                    head, own = (y, part), now
                elif head == (y, part):
                    common = len(np.intersect1d(own, now, assume_unique=True))
                    if common >= similarity * (len(own) + len(now) - common) - NEAR:
                        out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return asked.repartition("y", "part").sortWithinPartitions("y", "part", F.col("x").asc_nulls_first()).mapInArrow(run, "a long, b long")


def similar_groups(df: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(rid, first_rid) of each row of df (rid, doc_id, text): first_rid is the row of the smallest (doc_id, rid) of its group.

    df must be a written table (rid is the row's number and never changes). doc_id may be of
    any type with an order; nulls come last. Texts without a word form one group.
    """
    docs = stage(sketches(df, words), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    sets = stage(docs.groupBy("same").agg(first, F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("part").alias("part")), "sets")
    reps = sets.select(F.col("first.rid").alias("rid"), "fp", "size", "part")
    total = docs.agg(F.coalesce(F.sum("part"), F.lit(0)).alias("n")).first().n
    blocks, shared = partners(df, max(1, ceil(total / BLOCK)), words)
    alive = reps.join(shared, "rid", "left").where(F.coalesce("n", F.lit(0)) >= F.col("part") - (1 - similarity) * F.col("size") - NEAR)
    asked = stage(alive.where("size > 0").select("rid", "size"), "alive")
    discard(blocks)
    texts = stage(df.select("rid", "text").join(asked.select("rid"), "rid"), "texts")

    fps = reps.where("size > 0").groupBy("fp").agg(F.min("rid").alias("lead"))
    near = links(fps.select("fp"))
    linked = near.join(fps, near.a == fps.fp).select("b", F.col("lead").alias("x")).join(fps, F.col("b") == fps.fp).select("x", F.col("lead").alias("y"))
    same_fp = reps.where("size > 0").join(fps, "fp").where("rid <> lead").select(F.col("rid").alias("x"), F.col("lead").alias("y"))
    found = stage(alike(linked.union(same_fp), texts, words, similarity), "golay_links")
    roots = components(found)

    left = asked.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    met = stage(prefixes(texts, left, words, similarity), "prefixes")
    rooted = lambda: met.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    merged = lambda more: components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    for k in range(ROUNDS):
        new = stage(alike(stage(leads(rooted(), k, similarity), "leads"), texts, words, similarity), "lead_links")
        if new.isEmpty():
            break
        roots = merged(new)
    roots = merged(stage(alike(stage(crossing(rooted(), similarity), "crossing"), texts, words, similarity), "links"))
    labelled = sets.select("same", "first").join(roots, F.col("first.rid") == roots.node, "left").select("same", "first", F.coalesce("root", "first.rid").alias("root"))
    best = labelled.groupBy("root").agg(F.min("first").alias("first"))
    labels = stage(labelled.select("same", "root").join(best, "root").select("same", F.col("first.rid").alias("first_rid")), "labels")
    return docs.select("rid", "same").join(labels, "same").select("rid", "first_rid")
