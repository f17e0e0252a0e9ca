"""Operator 4: exact repeated substrings of the corpus, by a sparse enhanced suffix array.

Every byte that a string of ``LENGTH`` bytes covers which also starts elsewhere is found
and can be removed; matches never cross documents.

1. Anchors. Of each window of LENGTH bytes the smallest ``GRAM``-byte hash (leftmost at
   ties) is its anchor: equal windows have their anchor at the same place. Neighbouring
   windows with one anchor form a stretch; a text has about two stretches for each
   LENGTH - GRAM bytes, so suffixes are sorted only where they start at an anchor.
2. One shuffle by anchor hash. Stretches of equal content (a 48-bit hash beside the
   64-bit anchor hash) that occur twice are repeats as they stand. Where an anchor has
   different stretches, one of each goes on to be compared.
3. Comparison, of each anchor's different stretches: the suffixes from the anchor are
   sorted, with the common prefixes of neighbours; a stack scan of those gives the
   common-prefix interval tree. In an interval whose suffixes share r bytes, members
   are ranked by their reversed left contexts; a member whose left context agrees with
   another's for l bytes has a repeat of l + r bytes around the anchor. Intervals without diversity to
   the left give what their members share with all. All occurrences take part.
4. Anchors with more than ``HOT`` occurrences (a passage that a third of all texts hold) take
   neither of those groups: equal stretches are counted with partial aggregation and
   joined back, and the rest are compared by counting hashes of their single windows,
   partially aggregated, too. Both ways are exact and are tested against each other.

Texts are never held in Spark's memory as a whole and are shuffled twice, once where contexts are
fetched and once where repeats are cut out; groups are at most HOT stretches.

Cases: null and empty texts, and ones shorter than LENGTH, have no repeats and stay.
Repeated rows are repeats of each other. df is read three times and must give the same
rows in the same order (a scan or a written table does, as files are cut alike whatever executors are lost). Extra columns stay in remove().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import slices
from .columns import column, others, row, unpacked
from .staging import stage, steady_splits

LENGTH = 200
GRAM = 24
HOT = 50_000
SLICE = 1 << 20
PLACE = (1 << 24) - 1
BASE = 0x9E3779B97F4A7C15
COVER = "grp long, rid long, start long, end long"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_KEPT: dict = {}


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes on end."""
    if len(_KEPT.get("up", ())) < len(data) + 1:
        _KEPT["up"], _KEPT["down"] = _powers(max(len(data) + 1, SLICE + (1 << 16)))
    up, down = _KEPT["up"], _KEPT["down"]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor place, first window, last window) of the texts that end at ends, joined in data."""
    wide = LENGTH - GRAM + 1
    if len(data) < LENGTH:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    h = gram_hashes(data)
    least = (h & ~np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < wide:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    place = (least & np.uint64(PLACE)).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[: len(place)]) > 0)
    if not len(windows):
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    at = place[windows]
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(new[1:], len(at)) - 1
    return h[at[new]], at[new], windows[new], windows[last]


ANCHOR = "ahash long, tail long, rid long, pos long"


def _pieces(texts: list[bytes]):
    """(numbers, offsets, texts) of about SLICE bytes; a longer text comes in pieces that overlap by LENGTH - 1."""
    held: list = []
    size = 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), SLICE):
            piece = t[at : at + SLICE + LENGTH - 1]
            if held and size + len(piece) > SLICE:
                yield held
                held, size = [], 0
            held.append((k, at, piece))
            size += len(piece)
    if held:
        yield held


def anchors(docs: DataFrame) -> DataFrame:
    """(ahash, tail, rid, pos) of each stretch of docs (rid, text): tail has the content's hash, anchor - first and last - first window."""

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            rid = batch.column("rid").to_numpy()
            for piece in _pieces([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]):
                joined = b"".join(t for _, _, t in piece)
                ends = np.cumsum([len(t) for _, _, t in piece])
                h, p, a, b = stretches(np.frombuffer(joined, np.uint8), ends)
                own = np.searchsorted(ends, p, side="right")
                first = np.concatenate(([0], ends[:-1]))[own] - np.array([o for _, o, _ in piece], np.int64)[own]
                digest = xxhash.xxh64_intdigest
                content = np.fromiter((digest(joined[x : y + LENGTH]) for x, y in zip(a.tolist(), b.tolist())), np.uint64, len(a))
                tail = content << np.uint64(16) | (p - a).astype(np.uint64) << np.uint64(8) | (b - a).astype(np.uint64)
                rows = rid[np.array([k for k, _, _ in piece], np.int64)[own]]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tail.view(np.int64)), pa.array(rows), pa.array(p - first)], ["ahash", "tail", "rid", "pos"])

    return docs.select("rid", "text").mapInArrow(run, ANCHOR)


def _groups(batches, columns: list[str]):
    """Whole groups of equal first column, several at a time, from sorted batches; values as numpy arrays or lists of bytes."""
    held: list = []

    def whole(parts):
        out = []
        for k, name in enumerate(columns):
            chunks = [p.column(name) for p in parts]
            a = pa.chunked_array(chunks)
            out.append(a.to_pylist() if pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type) else a.to_numpy())
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(columns[0]).to_numpy()
        change = np.flatnonzero(key[1:] != key[:-1])
        if held and held[-1].column(columns[0])[-1].as_py() != key[0]:
            yield whole(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield whole([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield whole(held)


FOUND = "grp long, rid long, start long, end long, pos long, single boolean"


def _span(tail: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of the stretches."""
    t = tail.view(np.uint64)
    first = pos - (t >> np.uint64(8) & np.uint64(255)).astype(np.int64)
    return first, first + (t & np.uint64(255)).astype(np.int64) + LENGTH


def equal_stretches(rows: DataFrame) -> DataFrame:
    """Of anchors: repeats as they stand (single null), and one of each anchor's different stretches (single: is there just one?)."""

    def run(batches):
        for h, tail, rid, pos in _groups(batches, ["ahash", "tail", "rid", "pos"]):
            group = np.concatenate(([True], h[1:] != h[:-1]))
            new = group | np.concatenate(([True], tail[1:] != tail[:-1]))
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(h)))
            number = np.cumsum(group) - 1
            keys = np.bincount(number[first])
            lone = np.bincount(number[first], weights=n == 1)
            repeat = np.repeat(n > 1, n)
            asked = first[(keys[number[first]] > 1) & (lone[number[first]] > 0)]
            count = dict(zip(first.tolist(), n.tolist())) if len(asked) else {}
            rows_ = np.concatenate((np.flatnonzero(repeat), asked))
            start, end = _span(tail[rows_], pos[rows_])
            single = [None] * int(repeat.sum()) + [count[i] == 1 for i in asked.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[rows_]), pa.array(rid[rows_]), pa.array(start), pa.array(end), pa.array(pos[rows_]), pa.array(single, pa.bool_())], ["grp", "rid", "start", "end", "pos", "single"]
            )

    return rows.repartition("ahash").sortWithinPartitions("ahash", "tail").mapInArrow(run, FOUND)


CONTEXT = "grp long, rid long, start long, pos long, single boolean, content binary"


def contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The contents of the stretches asked for, from docs (rid, text)."""
    lists = asked.groupBy("rid").agg(F.collect_list(F.struct("grp", "start", "end", "pos", "single")).alias("asked"))

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            out: list = [[], [], [], [], [], []]
            for rid, text, rows in zip(*(batch.column(c).to_pylist() for c in ("rid", "text", "asked"))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for r in rows:
                    for column, v in zip(out, (r["grp"], rid, r["start"], r["pos"], r["single"], raw[r["start"] : r["end"]])):
                        column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["grp", "rid", "start", "pos", "single", "content"])

    return docs.select("rid", "text").join(lists, "rid").select("rid", "text", "asked").mapInArrow(run, CONTEXT)


def shared(x: bytes, y: bytes) -> int:
    """How many bytes x and y have in common from the start."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _minima(values: list[int]) -> list[np.ndarray]:
    """A sparse table for minima of ranges."""
    out = [np.array(values, np.int64)]
    while 2 << (len(out) - 1) <= len(values):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def _least(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of values[low:high], high > low."""
    k = np.frexp(high - low)[1] - 1
    out = np.empty(len(low), np.int64)
    for level in np.unique(k):
        own = k == level
        out[own] = np.minimum(table[level][low[own]], table[level][high[own] - (1 << level)])
    return out


def intervals(common: list[int]) -> list[tuple[int, int, int]]:
    """The common-prefix interval tree by a stack scan: (shared, low, high) of each interval, members low to high - 1, children first."""
    out, stack = [], [(0, 0)]
    for i, c in enumerate([*common, -1], start=1):
        low = i - 1
        while stack and stack[-1][0] > c:
            value, low = stack.pop()
            if i - low > 1:
                out.append((value, low, i))
        if c >= 0 and (not stack or stack[-1][0] < c):
            stack.append((c, low))
    return out


def compare(left: list[bytes], right: list[bytes]) -> list[tuple[int, int, int]]:
    """(member, l, r): member shares l bytes before and r from the anchor with another one, l + r >= LENGTH; left is reversed."""
    n = len(right)
    if n == 2:
        l, r = shared(left[0], left[1]), shared(right[0], right[1])
        return [(0, l, r), (1, l, r)] if l + r >= LENGTH else []
    order = sorted(range(n), key=right.__getitem__)
    common = [shared(right[a], right[b]) for a, b in zip(order, order[1:])]
    by_left = sorted(range(n), key=left.__getitem__)
    table = _minima([shared(left[a], left[b]) for a, b in zip(by_left, by_left[1:])])
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    place = rank[order]
    out = []
    for r, low, high in intervals(common):
        if r < GRAM:
            continue
        members = np.sort(place[low:high])
        between = _least(table, members[:-1], members[1:])
        most = np.maximum(np.append(between, 0), np.concatenate(([0], between)))
        fit = most + r >= LENGTH
        out += [(by_left[m], int(l), r) for m, l in zip(members[fit].tolist(), most[fit])]
    return out


def compared(rows: DataFrame) -> DataFrame:
    """Repeats of the single stretches among contexts, anchor by anchor."""

    def run(batches):
        for grp, rid, start, pos, single, content in _groups(batches, ["grp", "rid", "start", "pos", "single", "content"]):
            out = []
            edges = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1], [True])))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                cut = (pos[low:high] - start[low:high]).tolist()
                left = [c[:k][::-1] for c, k in zip(content[low:high], cut)]
                right = [c[k:] for c, k in zip(content[low:high], cut)]
                for m, l, r in compare(left, right):
                    if single[low + m]:
                        p = int(pos[low + m])
                        out.append((int(grp[low]), int(rid[low + m]), p - l, p + r))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["grp", "rid", "start", "end"])

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, COVER)


def windows(rows: DataFrame) -> DataFrame:
    """(grp, whash, rid, start, single) of each window of contexts, for anchors with very many stretches."""

    def run(batches):
        for batch in batches:
            out = []
            for grp, rid, start, single, content in zip(*(batch.column(c).to_pylist() for c in ("grp", "rid", "start", "single", "content"))):
                for k in range(len(content) - LENGTH + 1):
                    out.append((grp, xxhash.xxh64_intdigest(content[k : k + LENGTH]) - (1 << 63), rid, start + k, single))
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], ["grp", "whash", "rid", "start", "single"])

    return rows.mapInArrow(run, "grp long, whash long, rid long, start long, single boolean")


def _hot_repeats(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """What equal_stretches() and compared() give, for anchors of any number, by aggregation and joins."""
    counts = stage(rows.groupBy("ahash", "tail").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos")).alias("one")), "counts")
    first = (F.col("pos") - F.expr("shiftrightunsigned(tail, 8) & 255")).alias("start")
    size = F.expr("tail & 255") + LENGTH
    again = rows.join(counts.where("n > 1").select("ahash", "tail"), ["ahash", "tail"])
    whole = again.select(F.col("ahash").alias("grp"), "rid", first, (F.col("pos") - F.expr("shiftrightunsigned(tail, 8) & 255") + size).alias("end"))
    asked = counts.select(F.col("ahash").alias("grp"), "tail", "one.*", (F.col("n") == 1).alias("single")).select("grp", "rid", first, (F.col("pos") - F.expr("shiftrightunsigned(tail, 8) & 255") + size).alias("end"), "pos", "single")
    each = stage(windows(contexts(docs, asked)), "windows")
    often = each.groupBy("grp", "whash").agg(F.count("*").alias("n")).where("n > 1").select("grp", "whash")
    lone = each.where("single").join(often, ["grp", "whash"]).select("grp", "rid", "start", (F.col("start") + LENGTH).alias("end"))
    return whole.unionByName(lone)


def repeats(docs: DataFrame) -> DataFrame:
    """(grp, rid, start, end): occurrences of repeats in docs (rid, text), by anchor, as bytes; a byte is in some if and only if it is to go."""
    rows = anchors(docs)
    hot = stage(rows.groupBy("ahash").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("ahash"), "hot")
    found = stage(equal_stretches(rows.join(hot, "ahash", "left_anti")), "stretches")
    whole = found.where("single is null").select("grp", "rid", "start", "end")
    parts = whole.unionByName(compared(contexts(docs, found.where("single is not null"))))
    if hot.isEmpty():
        return parts
    return parts.unionByName(_hot_repeats(docs, rows.join(hot, "ahash")))


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """raw without spans, and the spans merged."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    kept, at = [], 0
    for start, end in merged:
        kept.append(raw[at:start])
        at = end
    return b"".join([*kept, raw[at:]]), [tuple(x) for x in merged]


def remove(df: DataFrame, text: str = "text") -> DataFrame:
    """df, without its text, with n_bytes, kept (binary) and spans array<struct<start, end>> (what is gone, merged)."""
    steady_splits(df.sparkSession)
    taken = (text, "n_bytes", "kept", "spans")
    docs = df.select(F.monotonically_increasing_id().alias("rid"), column(text).alias("text"), row(df, taken))
    lists = repeats(docs).groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            sizes, kept, spans = [], [], []
            for t, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass")
                rest, gone = cut(raw, [(x["start"], x["end"]) for x in found or ()])
                sizes.append(len(raw))
                kept.append(rest)
                spans.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pair)], ["row", "n_bytes", "kept", "spans"])

    joined = docs.join(lists, "rid", "left").select("row", "text", "found")
    new = StructType.fromDDL("n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>")
    cleaned = joined.mapInArrow(run, StructType([joined.schema["row"], *new.fields]))
    return cleaned.select(*unpacked(others(df, taken)), "n_bytes", "kept", "spans")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cleaned.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_repeats": op4_repeats}
