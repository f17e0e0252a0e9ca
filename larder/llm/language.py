"""Operator 7: language identification by rank-order n-gram profiles.

Training counts the letter n-grams (one to three letters, words padded by "_") of all
labelled texts. Each task adds up its own counts, Spark sums them by language and
n-gram, and a window keeps the ``PROFILE`` most frequent per language; Spark cuts that
window's input to ``PROFILE`` rows a language in each task before it shuffles, so no
language, however frequent, gathers in one task. A text is compared with each profile
by the out-of-place distance: the sum, over the text's own ``PROFILE`` most frequent
n-grams, of the difference of ranks, ``PROFILE`` where the profile lacks the n-gram.

The profiles are all that reaches the driver and the workers, as sparse rows of 12 bytes,
in parts of ``MAX_LANGUAGES`` times ``PROFILE`` rows (5 MB) at most; each text is held against
every part. Prediction shuffles nothing.

Cases: a null text, or one without a letter, is ``und`` with score 0. Ties of
frequency go to the smaller n-gram, ties of distance to the first language by name.
Rows with a null language are not learnt from; with nothing to learn from, every text
is ``und``. Columns of the input stay; equal names (in any case) are overwritten.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import extended

PROFILE = 400
MAX_LANGUAGES = 1_000
GAP = ord("_")
HELD = 4 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str | None) -> np.ndarray:
    """The text's n-grams, repeats included; each is its code points, 21 bits apiece."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.empty(0, np.int64)
    points[~is_letter] = GAP
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    row = np.concatenate(([GAP], points[keep], [GAP]))
    if row[-2] == GAP:
        row = row[:-1]
    inner = row != GAP
    pairs = row[:-1] << 21 | row[1:]
    triples = (pairs[:-1] << 21 | row[2:])[inner[1:-1]]
    return np.concatenate((row[inner], pairs, triples))


def counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        codes = np.sort(codes)
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
        return codes[first], np.diff(np.append(first, len(codes)))
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(weights, first)


def ranked(text: str | None, size: int = PROFILE) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first."""
    codes, n = counted(grams(text))
    return codes[np.argsort(-n, kind="stable")[:size]]


def train(df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """Profiles (lang, place from 0, gram) of all rows of df with a language."""

    def run(batches):
        held: dict[str, list] = {}
        sums: dict[str, tuple] = {}
        waiting: dict[str, int] = {}

        def settle(name):
            if held.get(name):
                new = counted(np.concatenate(held.pop(name)))
                old = sums.get(name)
                sums[name] = counted(np.concatenate((old[0], new[0])), np.concatenate((old[1], new[1]))) if old else new
                waiting[name] = 0

        def rows(names):
            for name in names:
                settle(name)
                if name in sums:
                    codes, n = sums.pop(name)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1)):
                codes = grams(t.as_py())
                name = name.as_py()
                held.setdefault(name, []).append(codes)
                waiting[name] = waiting.get(name, 0) + len(codes)
                if waiting[name] > HELD:
                    settle(name)
                    if sum(len(c) for c, _ in sums.values()) > HELD:
                        yield from rows(list(sums))
        yield from rows(sorted({*held, *sums}))

    labelled = df.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = labelled.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("place", place - 1).where(F.col("place") < size).select("lang", "place", "gram")


class Profiles:
    """Profiles of up to MAX_LANGUAGES languages, by n-gram: where codes[i] stands in which languages, as sparse rows."""

    def __init__(self, rows: list):
        self.langs = sorted({r.lang for r in rows})
        number = {name: k for k, name in enumerate(self.langs)}
        order = sorted(rows, key=lambda r: r.gram)
        self.codes, starts = np.unique(np.array([r.gram for r in order], np.int64), return_index=True)
        self.starts = np.append(starts, len(order))
        self.lang = np.array([number[r.lang] for r in order], np.int16)
        self.place = np.array([r.place for r in order], np.int16)

    def distances(self, text: str | None, size: int) -> np.ndarray | None:
        """Out-of-place distance to each language, as a share of the largest possible; None without letters."""
        own = ranked(text, size)
        if not len(own) or not len(self.codes):
            return None
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        rank = np.flatnonzero(self.codes[at] == own)
        at = at[rank]
        n = self.starts[at + 1] - self.starts[at]
        rows = np.repeat(self.starts[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        saved = size - np.abs(self.place[rows].astype(np.int64) - np.repeat(rank, n))
        return 1 - np.bincount(self.lang[rows], weights=saved, minlength=len(self.langs)) / (size * len(own))


def parts(profiles: DataFrame, size: int = PROFILE) -> list[Profiles]:
    """The profiles in parts of MAX_LANGUAGES languages at most, in order of their names."""
    names = profiles.select("lang").distinct()
    n = ceil(names.count() / MAX_LANGUAGES)
    if n < 2:
        return [Profiles(profiles.limit(MAX_LANGUAGES * size).collect())]
    numbered = profiles.join(names.withColumn("part", F.ntile(n).over(Window.orderBy("lang"))), "lang")
    return [Profiles(numbered.where(F.col("part") == k + 1).limit(MAX_LANGUAGES * size).collect()) for k in range(n)]


def predict(df: DataFrame, profiles: DataFrame, text: str = "text", size: int = PROFILE) -> DataFrame:
    """The rows of df with lang_pred and score (1 minus the smallest distance)."""
    sc = df.sparkSession.sparkContext
    shared = [sc.broadcast(p) for p in parts(profiles, size)]

    def run(texts):
        names, scores = [], []
        for t in texts:
            name, score = "und", 0.0
            for part in shared:
                d = part.value.distances(t.as_py(), size)
                best = -1 if d is None else int(d.argmin())
                if best >= 0 and (name == "und" or 1 - d[best] > score):
                    name, score = part.value.langs[best], float(1 - d[best])
            names.append(name), scores.append(score)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return extended(df, text, "lang_pred string, score double", run)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), profiles).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op7_language": op7_language}
