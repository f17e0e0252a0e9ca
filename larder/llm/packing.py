"""Operator 11: best-fit packing of tokenized documents into sequences of bounded length.

pieces() tokenizes whole texts in the tasks that read them, ends each document with a separator, and cuts
those that are longer than a sequence. pack() gives every piece a sequence and an offset,
as best-fit decreasing does: longest first, each into the tightest open sequence that still takes it.

Best fit looks at lengths only, and pieces of equal length are alike. So Spark counts
pieces by length (at most ``capacity`` rows, whatever the table's size), and the packing of the
counts is planned once: a segment tree over remaining capacities finds the tightest open
bins that take a length in logarithmic time, and all pieces that best fit would put there one
after the other go there in one step, as a run: piece number t of the run stands in bin t // q from the run's first bin, in
place t % q. The plan is what the sequential method does for each document; its size
depends on the capacity, not on the number of documents.

Every piece finds its run by its rank among the pieces of its length. A rank is the piece's rank in its
own written part plus the count of that length in the parts before: parts are counted where they are written, and the
counts are summed up by length. No task holds all pieces of a length, neither where one length has a third of all rows.

Cases: a null text is an empty one, and an empty text is its separator alone. Repeated rows and equal ids are packed
each on its own. An empty table gives no rows. All other columns stay with each piece, but for those that are
called like new ones. Texts of any length are encoded whole: words between blanks are met once a slice of
texts, and a worker remembers a bounded number of them (merges of many new words are made together, in arrays); lost executors cost a part of the written table, whose ranks never change afterwards.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import byte_letters, slices
from .columns import column, others, row, unpacked
from .staging import stage

CAPACITY, SEPARATOR = 2048, 0
#: Words and pieces of words that a worker remembers: two generations of so many.
CACHE_WORDS, CACHE_PIECES, CACHE_LENGTH = 250_000, 100_000, 48
#: Pieces of words with more bytes go to the library.
LONGEST = 64
#: Bytes of text that a worker encodes together.
SLICE = 4 << 20
#: Words of ASCII and Latin letters, whose small letters are as many as their large ones; all other words go to the library.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN_WORD = re.compile(f"(?!.*(?:<\\||İ))[!-~{LATIN}]+")
#: Fixed value: the vocabulary's pattern of pieces, for such words, and the line feed between words.
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^0-9\\n{LATIN}]+|\\n")
WORD_END = "</w>"
#: Stands between words, for no token.
LINE_ID = (1 << 32) - 1
LINE = np.array([LINE_ID], "<u4").tobytes()


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memory(dict):
    """A dict that forgets: what two generations did not hold or look up any more is gone."""

    def __init__(self, most: int):
        self.most, self.older = most, {}

    def look_up(self, keys: list, learn) -> list:
        """The values of all keys, which differ; learn(missing keys) gives those that are not known yet."""
        found = list(map(self.get, keys))
        new = [i for i, x in enumerate(found) if x is None]
        if len(self) + len(new) > self.most:
            self.older = dict(self)
            self.clear()
        if self.older:
            for i in new:
                found[i] = self.older.get(keys[i])
            self.update((keys[i], found[i]) for i in new if found[i] is not None)
            new = [i for i in new if found[i] is None]
        for i, value in zip(new, learn([keys[i] for i in new])):
            found[i] = value
            if len(keys[i]) <= CACHE_LENGTH:
                self[keys[i]] = value
        return found


class Words:
    """Token ids as the tokenizers library gives them: no token of this vocabulary crosses a blank, so each word is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        letters = sorted(byte_letters().items(), key=lambda x: x[1])
        self.first = np.array([vocab[c] for c, _ in letters], np.int64)
        self.last = np.array([vocab[c + WORD_END] for c, _ in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[x] << 16 | vocab[y] for x, y in pairs], np.int64)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        self.rank_of = np.argsort(keys)
        self.keys = np.append(keys[self.rank_of], np.iinfo(np.int64).max)
        self.rank_of = np.append(self.rank_of, len(pairs))
        self.words, self.pieces = Memory(CACHE_WORDS), Memory(CACHE_PIECES)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; the number of merges where there is none."""
        key = left << 16 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank_of[at], len(self.made))

    def merged(self, rows: np.ndarray):
        """(numbers, ids) of rows of equally many bytes: every round merges each row's pair of least rank, leftmost first."""
        parts = self.first[rows]
        parts[:, -1] = self.last[rows[:, -1]]
        of, none = np.arange(len(rows)), len(self.made)
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        while parts.shape[1] > 1:
            own, places = np.arange(len(of)), np.arange(parts.shape[1])
            at = ranks.argmin(axis=1)
            least = ranks[own, at]
            going = least < none
            if not going.all():
                yield of[~going], parts[~going]
                of, parts, ranks, at, least = of[going], parts[going], ranks[going], at[going], least[going]
                own = np.arange(len(of))
                if not len(of):
                    return
            parts[own, at] = self.made[least]
            parts = parts[places != at[:, None] + 1].reshape(len(of), -1)
            ranks = ranks[places[:-1] != at[:, None]].reshape(len(of), -1)
            for pair in (at - 1, at):
                has = np.flatnonzero((pair >= 0) & (pair < ranks.shape[1]))
                ranks[has, pair[has]] = self.ranks(parts[has, pair[has]], parts[has, pair[has] + 1])
        yield of, parts

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        out, by_size = [b""] * len(pieces), defaultdict(list)
        for i, piece in enumerate(pieces):
            by_size[len(piece) if piece.isascii() else len(piece.encode())].append(i)
        for size, group in by_size.items():
            if size > LONGEST:
                for i in group:
                    out[i] = self.by_library(pieces[i])
                continue
            rows = np.frombuffer("".join(map(pieces.__getitem__, group)).encode(), np.uint8).reshape(-1, size)
            for of, parts in self.merged(rows):
                ids, step = parts.astype("<u4").tobytes(), 4 * parts.shape[1]
                for k, i in enumerate(of.tolist()):
                    out[group[i]] = ids[k * step : k * step + step]
        return out

    def of_words(self, words: list[str]) -> list[bytes]:
        out: list = [None if PLAIN_WORD.fullmatch(w) else self.by_library(w) for w in words]
        plain = [i for i, x in enumerate(out) if x is None]
        if not plain:
            return out
        found = PIECE.findall("\n".join(map(words.__getitem__, plain)).lower())
        own = list(set(found) - {"\n"})
        known = dict(zip(own, self.pieces.look_up(own, self.of_pieces)))
        known["\n"] = LINE
        ids = b"".join(map(known.__getitem__, found))
        start = 0
        ends = (4 * np.flatnonzero(np.frombuffer(ids, "<u4") == LINE_ID)).tolist()
        for i, end in zip(plain, [*ends, len(ids)]):
            out[i] = ids[start:end]
            start = end + 4
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one text after the other, where each text ends in them); a null text is an empty one."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        n = len(coded.dictionary)
        own = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), coded.dictionary), pa.scalar("\n", pa.large_string()))[0].as_py().split("\n") if n else []
        known = self.words.look_up(own, self.of_words)
        ids = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        word = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[word]
        ends = np.cumsum(each)
        from_ = np.repeat((np.cumsum(sizes) - sizes)[word] - (ends - each), each)
        from_ += np.arange(len(from_))
        all_ids = ids[from_]
        offsets = split.offsets.to_numpy()
        return all_ids, np.concatenate([[0], ends])[offsets[1:] - offsets[0]]


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


PIECES = "piece int, start long, length long, ids binary"


def pieces(df: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, keep_text: bool = False) -> DataFrame:
    """A row for each piece of each document: piece, start, length, ids (little-endian unsigned 32-bit numbers)."""
    path = path or vocabulary_path()
    new = StructType.fromDDL(PIECES)
    kept = others(df, new.names + ([] if keep_text else [text]))
    rows = df.select(row(df, others(df, kept)), column(text).cast("string").alias("text"))

    def run(batches):
        tokenizer, end = words(path), np.array([separator], "<u4").tobytes()
        for part in slices(batches, 1, SLICE):
            all_ids, ends = tokenizer.encode(part.column(1))
            data, first = all_ids.tobytes(), 0
            of, at, starts, ids = [], [], [], []
            for i, last in enumerate(ends.tolist()):
                coded = data[4 * first : 4 * last] + end
                for n, start in enumerate(range(0, len(coded) // 4, capacity)):
                    of.append(i), at.append(n), starts.append(start), ids.append(coded[4 * start : 4 * (start + capacity)])
                first = last
            arrays = [pa.array(at, pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), *arrays], ["row", *new.names])

    done = rows.mapInArrow(run, StructType([rows.schema["row"], *new.fields]))
    return done.select(*[F.col("row").getField(c).alias(c) for c in kept], *new.names)


class Bins:
    """Open bins by what they still take: a segment tree over capacities, with the bins of each capacity as runs of ids."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def put(self, left: int, first: int, n: int) -> None:
        self.runs[left].append((first, n))
        self._add(left, n)

    def take(self, left: int) -> tuple[int, int]:
        first, n = self.runs[left].pop()
        self._add(left, -n)
        return first, n

    def _add(self, left: int, n: int) -> None:
        at = left + self.size
        while at:
            self.open[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity >= need that an open bin has."""
        at = need + self.size
        while not self.open[at]:
            while at & 1:  # a right child: nothing more on this level
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


RUN = "length int, first_rank long, n long, each int, first_bin long, base int"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first_rank, n, each, first_bin, base) of best-fit decreasing for so many pieces of each length.

    Piece first_rank + t of the length goes to bin first_bin + t // each at offset base + t % each * length.
    """
    bins, runs, opened = Bins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while n:
            left = bins.tightest(length)
            if left is None:
                left = capacity
                each = left // length
                first, have = opened, -(-n // each)
                opened += have
            else:
                each = left // length
                first, have = bins.take(left)
            full = min(have, n // each)
            part = n - full * each if full < have else 0
            if full:
                runs.append((length, rank, full * each, each, first, capacity - left))
                rank, n = rank + full * each, n - full * each
                if left - each * length:
                    bins.put(left - each * length, first, full)
            if part:
                runs.append((length, rank, part, part, first + full, capacity - left))
                n = 0
                if left - part * length:
                    bins.put(left - part * length, first + full, 1)
            rest = have - full - bool(part)
            if rest:
                bins.put(left, first + have - rest, rest)
    return runs


def _numbered(df: DataFrame) -> DataFrame:
    """df as a written table with part and local (rank among its part's rows of equal length)."""
    names = [f"_{n}" for n in ("part", "local")]
    rows = df.select(F.col("length").cast("long").alias("length"), row(df))

    def run(batches):
        part, counts = TaskContext.get().partitionId(), {}
        for batch in batches:
            local = []
            for length in batch.column(0).to_pylist():
                local.append(counts.get(length, 0))
                counts[length] = local[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int64()), pa.array(local, pa.int64())], ["length", "row", *names])

    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"{names[0]} long, {names[1]} long").fields])
    return stage(rows.mapInArrow(run, schema), "pieces")


def pack(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """df, which has a length from 1 to capacity in each row, with sequence_id and offset (both long)."""
    kept = others(df, ["sequence_id", "offset"])
    rows = _numbered(df.select(*map(column, kept)))
    counts = rows.groupBy("length", "_part").agg(F.count("*").alias("n"))
    counts = stage(counts, "lengths")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    if any(k is None or not 0 < k <= capacity for k in total):
        raise ValueError(f"lengths must go from 1 to {capacity}")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = rows.join(counts.select("length", "_part", F.coalesce(before, F.lit(0)).alias("before")), ["length", "_part"]).select("row", "length", (F.col("before") + F.col("_local")).alias("rank"))
    runs = np.array(sorted(plan(total, capacity)), np.int64).reshape(-1, 6)
    shared = df.sparkSession.sparkContext.broadcast(runs)  # bounded by the capacity

    def run(batches):
        length, first_rank, _, each, first_bin, base = shared.value.T
        starts = np.searchsorted(length, np.arange(capacity + 2))
        for batch in batches:
            own, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            at = np.empty(len(own), np.int64)
            for value in np.unique(own):
                of = own == value
                a, b = starts[value], starts[value + 1]
                at[of] = a + np.searchsorted(first_rank[a:b], rank[of], side="right") - 1
            t = rank - first_rank[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first_bin[at] + t // each[at]), pa.array(base[at] + t % each[at] * own)], ["row", "sequence_id", "offset"])

    done = ranked.mapInArrow(run, StructType([rows.schema["row"], *StructType.fromDDL("sequence_id long, offset long").fields]))
    return done.select(*unpacked(kept), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed pieces' ids one behind the other; a group holds one sequence, so it is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return joined.select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"), ids.alias("ids"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    slim = pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(slim)


QUERIES = {"op11_packing": op11_packing}
