"""Operator 1: byte-level BPE encoding and decoding with a given public vocabulary.

A text is cut at the special strings, then into short words by the vocabulary's
pattern. Of each word a contiguous array holds the boundaries of its parts and the
rank of the pair that starts at each; the smallest rank is looked for again and again,
its inner boundary deleted and the neighbouring ranks looked up anew. Words repeat, so
each Python worker keeps the ids of the words it has met, up to a bound.

Nothing is shuffled: every row is encoded where it was read. A lost executor only
means that its input splits are read again. Memory is one Arrow batch plus the cache.

Cases: a null text encodes as an empty one (no ids, empty decoded text). Words longer
than ``SCAN_LIMIT`` bytes, which the scan would take quadratic time for, take a heap
over linked parts and give the same merges (smallest rank, leftmost first). Repeated
rows give repeated results. All columns of the input stay, also ones named like the
new columns would be if ``keep`` names other ones; equal names are overwritten.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import extended

#: Fixed value: the word pattern of the byte-level vocabulary.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
SCAN_LIMIT = 96
CACHE_WORDS = 400_000
NO_RANK = 1 << 60


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """One vocabulary, with its merges by rank and the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_letters()
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: as_bytes(s) for s, i in vocab.items() if s not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.first = [vocab[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.words: dict[str, tuple[int, ...]] = {}
        self.find = regex.compile(WORD_PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def scan(self, word: bytes) -> tuple[int, ...]:
        """Contiguous rank array: parts[i] starts at boundary i, ranks[i] is that of parts i and i + 1."""
        rank, made = self.ranks.get, self.made
        first = self.first
        parts = [first[b] for b in word]
        ranks = [rank(p, NO_RANK) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < NO_RANK:
            i = ranks.index(least)
            part = parts[i] = made[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((part, parts[i + 1]), NO_RANK)
            if i:
                ranks[i - 1] = rank((parts[i - 1], part), NO_RANK)
        return tuple(parts)

    def long(self, word: bytes) -> tuple[int, ...]:
        """The same merges for a long word: a heap of (rank, place) over linked parts."""
        parts, n = [self.first[b] for b in word], len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (m := self.ranks.get((parts[i], parts[after[i]]))) is not None:
                heapq.heappush(heap, (m, i, parts[i], parts[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j], after[i] = self.made[rank], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return tuple(p for p in parts if p >= 0)

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        ids = self.scan(raw) if len(raw) <= SCAN_LIMIT else self.long(raw)
        if len(raw) <= SCAN_LIMIT:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        pieces = self.cut.split(text) if self.cut else [text]
        out = []
        for k, piece in enumerate(pieces):
            if k % 2:
                out.append((self.special[piece],))
                continue
            known = self.words.get
            words = self.find(piece)
            out.extend(ids if (ids := known(w)) is not None else self.word(w) for w in words)
        return np.fromiter(chain.from_iterable(out), dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def id_array(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *rows]), pa.int32()))


def slices(batches: Iterator[pa.RecordBatch], column: str | int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that their texts are of about ``most`` bytes at a time."""
    for batch in batches:
        sizes = np.diff(np.frombuffer(batch.column(column).cast(pa.large_string()).buffers()[1], np.int64)[: batch.num_rows + 1]) if batch.num_rows else []
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def encode(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids") -> DataFrame:
    """The rows of df with their texts' token ids, as array<int>."""
    path = path or vocabulary_path()

    def run(texts):
        c = codec(path)
        return [id_array([c.encode(t or "") for t in texts.to_pylist()])]

    return extended(df, text, f"`{ids}` array<int>", run, cut=slices)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, text: str = "decoded") -> DataFrame:
    """The rows of df with the text that their ids stand for."""
    path = path or vocabulary_path()

    def run(rows):
        c = codec(path)
        return [pa.array([c.decode(x or []) for x in rows.to_pylist()], pa.string())]

    return extended(df, ids, f"`{text}` string", run)


def round_trip(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """encode() and decode() in one pass over the text: ids array<int>, decoded string; the text goes."""
    path = path or vocabulary_path()

    def run(texts):
        c = codec(path)
        rows = [c.encode(t or "") for t in texts.to_pylist()]
        return [id_array(rows), pa.array([c.decode(x.tolist()) for x in rows], pa.string())]

    return extended(df, text, "ids array<int>, decoded string", run, keep_text=False, cut=slices)


def digests(coded: DataFrame) -> DataFrame:
    """What op1 returns, from the output of round_trip()."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(round_trip(docs))


QUERIES = {"op1_bpe": op1_bpe}
