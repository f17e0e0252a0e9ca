"""Operator 2: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Seeds are the word n-grams (``SEED`` words; all words of a shorter item) of the items
that occur in ``COMMON`` items at most; an item with fewer than ``LEAST`` such seeds
keeps all of its n-grams, so that each item can be found. A text that holds a seed is
aligned with the item around each hit: local alignment over words, ``MATCH`` for an
equal word, ``MISS`` for another, ``GAP`` for a skipped one, which tolerates replaced,
added and dropped words. The score is the best alignment's share of the item's own.

The items are sent to the workers only where they have ``SMALL_ITEMS`` rows and
``SMALL_CHARS`` characters at most, which is counted first; the texts are then read
once and not shuffled. Beyond that seeds and texts meet in a join: n-gram hashes of
all texts against seed hashes, the seeds met by each (row, item) pair, then the same
alignment around these seeds only. Both ways know items by a row number, not by their
item_id, and give the same rows; neither has a limit on hits. What is sent is bounded by these
two limits: 2 MB of text and, with a seed a word at most, some 400,000 seeds.

Cases: null texts and items, and ones without a word, match nothing. Repeated rows and
items each give their own results, and so do items of null or repeated ids. Equal scores stay apart as rows of their own. An
empty table gives no leaks. Columns of the input stay; "leaks" is overwritten.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .columns import column, extended, others, row, unpacked
from .staging import stage

SEED = 4
COMMON = 8
LEAST = 4
MATCH, MISS, GAP = 2, -1, -1
SCORE = 0.5
SMALL_ITEMS = 10_000
SMALL_CHARS = 2_000_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)

words_of = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    return words_of((text or "").lower())


@lru_cache(maxsize=1 << 18)
def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each n words on end."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * FACTOR
        out ^= out >> np.uint64(29)
    return out


def item_grams(text: str | None) -> tuple[int, np.ndarray]:
    """The size and the hashes of an item's n-grams."""
    h = np.array([word_hash(w) for w in words(text)], np.uint64)
    n = min(SEED, len(h))
    return n, gram_hashes(h, n) if n else np.empty(0, np.uint64)


def align(item: list[str], text: list[str]) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of item's words in text's words; end exclusive."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(item))}
    row = np.array([ids.get(w, -1) for w in text])
    n = len(row)
    at = np.arange(n + 1)
    before, starts = np.zeros(n + 1, np.int64), at.copy()
    best = (0, 0, 0)
    for w in item:
        cell = before[:-1] + np.where(row == ids[w], MATCH, MISS)
        start = starts[:-1].copy()
        skipped = before[1:] + GAP
        better = skipped > cell
        cell[better], start[better] = skipped[better], starts[1:][better]
        none = cell <= 0
        cell[none], start[none] = 0, at[1:][none]
        # a gap along the text: the best cell to the left, less GAP a word
        raised = np.concatenate(([0], cell)) - GAP * at
        top = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == top, at, 0))
        now = np.maximum(top + GAP * at, 0)
        start = np.concatenate(([0], start))[source]
        start[now == 0] = at[now == 0]
        before, starts = now, start
        k = int(now.argmax())
        if now[k] > best[0]:
            best = (int(now[k]), int(start[k]), k)
    return best


def leak(item: list[str], text: list[str], hits: list[tuple[int, int]]) -> tuple[float, int, int] | None:
    """The best alignment of item around the hits (place in text, place in item), as (score, first word, end word)."""
    size, slack = len(item), len(item) // 2 + 2
    windows: list[list[int]] = []
    for p, q in sorted(hits, key=lambda x: x[0] - x[1]):
        low, high = max(0, p - q - slack), min(len(text), p - q + size + slack)
        if windows and low <= windows[-1][1]:
            windows[-1][1] = max(windows[-1][1], high)
        else:
            windows.append([low, high])
    best = None
    for low, high in windows:
        score, start, end = align(item, text[low:high])
        share = score / (MATCH * size)
        if share >= SCORE and (best is None or share > best[0]):
            best = (share, low + start, low + end)
    return best


def spans(text: str) -> list[tuple[int, int]]:
    """Where the words of the lowered text are; as code points of the text itself where lowering keeps its length."""
    return [m.span() for m in re.finditer(r"\w+", text.lower())]


def seeds(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(gram, n, item_id): the rare n-grams of each item."""

    def run(batches):
        for batch in batches:
            rows = [(g, n, i.as_py()) for i, t in zip(batch.column(0), batch.column(1)) for n, grams in [item_grams(t.as_py())] for g in np.unique(grams).view(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["gram", "n", "item_id"])

    grams = items.select(F.col(item_id).cast("long").alias("item_id"), text).mapInArrow(run, "gram long, n int, item_id long").distinct()
    common = grams.groupBy("gram", "n").agg(F.count("*").alias("items"))
    told = grams.join(common, ["gram", "n"])
    rare = told.groupBy("item_id").agg(F.count_if(F.col("items") <= COMMON).alias("rare"))
    return told.join(rare, "item_id").where((F.col("items") <= COMMON) | (F.col("rare") < LEAST)).select("gram", "n", "item_id")


def is_small(items: DataFrame, text: str = "text") -> bool:
    r = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars")).first()
    return r.n <= SMALL_ITEMS and r.chars <= SMALL_CHARS


class Index:
    """The items of a small benchmark with their seeds, as every worker holds them.

    items are (row number, item_id, text), chosen (gram, n, row number).
    """

    def __init__(self, items: list[tuple], chosen: list[tuple]):
        self.items = [(i, words(t)) for _, i, t in items]
        self.vocabulary = {w: word_hash(w) for _, ws in self.items for w in ws}
        wanted: dict[int, set] = {}
        for gram, _, number in chosen:
            wanted.setdefault(number, set()).add(gram)
        self.places: dict[int, list] = {}
        self.sizes = set()
        for k, (number, _, t) in enumerate(items):
            n, grams = item_grams(t)
            for q, g in enumerate(grams.view(np.int64).tolist()):
                if g in wanted.get(number, ()):
                    self.places.setdefault(g, []).append((k, q))
                    self.sizes.add(n)
        self.grams = np.array(sorted(self.places), np.int64)

    def leaks(self, text: str | None) -> list[dict]:
        if not text or not len(self.grams):
            return []
        ws = words(text)
        known = self.vocabulary.get
        h = np.fromiter((known(w, 0) for w in ws), np.uint64, len(ws))
        inside = h != 0
        hits: dict[int, list] = {}
        for n in self.sizes:
            if len(h) < n:
                continue
            all_in = inside[: len(h) - n + 1].copy()
            for k in range(1, n):
                all_in &= inside[k : len(h) - n + 1 + k]
            there = np.flatnonzero(all_in)
            if not len(there):
                continue
            g = np.zeros(len(there), np.uint64)
            for k in range(n):
                g = (g ^ h[there + k]) * FACTOR
                g ^= g >> np.uint64(29)
            g = g.view(np.int64)
            at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
            for p, gram in zip(there[self.grams[at] == g].tolist(), g[self.grams[at] == g].tolist()):
                for k, q in self.places[gram]:
                    hits.setdefault(k, []).append((p, q))
        out, where = [], None
        for k, found in sorted(hits.items()):
            i, item = self.items[k]
            if best := leak(item, ws, found):
                where = where or spans(text)
                out.append({"item_id": i, "score": best[0], "start": where[best[1]][0], "end": where[best[2] - 1][1]})
        return out


def numbered(items: DataFrame) -> DataFrame:
    """(_item, item_id, text) of items, written, with a row number each."""
    return stage(items.select(F.monotonically_increasing_id().alias("_item"), "item_id", "text"), "items")


def leak_type(items: DataFrame) -> str:
    """The type of a leak; item_id has the type that it has in items."""
    return f"struct<item_id:{items.schema['item_id'].dataType.simpleString()},score:double,start:bigint,end:bigint>"


def _by_workers(df: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """find() for a small benchmark."""
    items = numbered(items)
    index = Index([tuple(r) for r in items.collect()], [tuple(r) for r in seeds(items, "_item").collect()])
    shared = df.sparkSession.sparkContext.broadcast(index)
    new = f"leaks array<{leak_type(items)}>"
    kind = to_arrow_type(StructType.fromDDL(new)["leaks"].dataType)
    found = extended(df, text, new, lambda texts: [pa.array([shared.value.leaks(t.as_py()) for t in texts], kind)])
    return found.withColumn("leaks", F.array_sort("leaks"))


def _by_join(df: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """find() for a benchmark of any size."""
    items = numbered(items)
    rows = stage(df.select(F.monotonically_increasing_id().alias("_row"), row(df, ("leaks",)), column(text).alias("_text")), "rows")
    chosen = stage(seeds(items, "_item"), "seeds")
    sizes = sorted(r.n for r in chosen.select("n").distinct().collect())  # SEED values at most

    def grams(batches):
        for batch in batches:
            for number, t in zip(batch.column(0), batch.column(1)):
                h = np.array([word_hash(w) for w in words(t.as_py())], np.uint64)
                for n in sizes:
                    g = np.unique(gram_hashes(h, n)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), n, np.int32)), pa.array(np.full(len(g), number.as_py(), np.int64))], ["gram", "n", "_row"])

    texts = rows.select("_row", "_text")
    met = texts.mapInArrow(grams, "gram long, n int, _row long").join(chosen.withColumnRenamed("item_id", "_item"), ["gram", "n"]).groupBy("_row", "_item").agg(F.collect_set("gram").alias("_grams"))
    pairs = met.join(texts, "_row").join(items.select("_item", "item_id", F.col("text").alias("_words")), "_item")
    leak = leak_type(items)
    kind = to_arrow_type(StructType.fromDDL(f"leak {leak}")["leak"].dataType)

    def aligned(batches):
        for batch in batches:
            out = []
            for number, i, t, item, met_grams in zip(*(batch.column(c).to_pylist() for c in ("_row", "item_id", "_text", "_words", "_grams"))):
                one = Index([(0, i, item)], [(g, 0, 0) for g in met_grams])
                out += [{"_row": number, "leak": x} for x in one.leaks(t)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("_row", pa.int64()), ("leak", kind)]))

    found = pairs.mapInArrow(aligned, f"_row long, leak {leak}").groupBy("_row").agg(F.array_sort(F.collect_list("leak")).alias("leaks"))
    none = F.array().cast(f"array<{leak}>")
    return rows.join(found, "_row", "left").select(*unpacked(others(df, ("leaks",))), F.coalesce("leaks", none).alias("leaks"))


def find(df: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """df with leaks array<struct<item_id, score, start, end>>: the items of items (item_id of any type, text) that its texts hold."""
    own = items.select("item_id", "text")
    return _by_workers(df, own, text) if is_small(own) else _by_join(df, own, text)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*").withColumnRenamed("start", "char_start").withColumnRenamed("end", "char_end")


QUERIES = {"op2_decontaminate": op2_decontaminate}
