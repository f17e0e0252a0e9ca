"""Packing, clustering and fill-in-middle on small tables, against brute force and the tokenizers library."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import centroids, infill, packing, registry

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "a", "a\nb\n", "é" * 300, "\n\n\nx\n", "<P>x\ny", "line\n" * 900, "😀\n😀😀\n\tend", "<|endoftext|> don't STOP", "x" * 5000, "a b " * 3000, "a\nb\n"]


def docs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumns({"Form": F.lit("clash"), "row": F.lit(1), "a.b `c`": F.lit("odd"), "Length": F.lit("clash"), "offset": F.lit(0), "_part": F.lit(7)})


# fill-in-middle


def brute_infill(key, text):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(lines)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill_equals_brute_force_and_is_undone(spark):
    texts = ODD * 4
    rows = infill.infill(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.units, r.form, r.prefix_chars, r.middle_chars, r.infill) == brute_infill(r.doc_id, text)
        assert r.restored == text and r["a.b `c`"] == "odd" and r.row == 1
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert infill.infill(docs(spark, ODD).limit(0)).count() == 0
    assert infill.infill(docs(spark, ["x"]).withColumn("doc_id", F.lit(None).cast("long"))).first().infill == brute_infill(None, "x")[-1]
    assert infill.infill(docs(spark, ODD), rate=0).where("form <> 'plain'").count() == 0


def test_rotations_of_all_cuts():
    for n in range(6):
        for cut in range(n + 1):
            x = bytearray(range(n + 2))
            infill.rotate(x, 1, 1 + cut, 1 + n)
            own = list(range(1, n + 1))
            assert list(x) == [0, *own[cut:], *own[:cut], n + 1]


# packing


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    t.no_truncation(), t.no_padding()
    return t


def test_ids_equal_the_tokenizers_library(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    own, t, rng = packing.Words(packing.vocabulary_path()), library(), random.Random(5)
    letters = [*"abcdeEÉéèàßſKÅﬁ0189 .,!?'\"-_\n\t\x1c\x85\xa0 İΣσςДж中文字😀👍🏽ẽ́̈ª½²Ⅷ٣<|>\x00’", "<|endoftext|>", "<|startoftext|>", "'s", "I'LL", "</w>", "x" * 70, "qz" * 60]
    texts = [None if k % 50 == 0 else "".join(rng.choice(letters) for _ in range(rng.randrange(40))) for k in range(1500)]
    for i in range(0, len(texts), 100):
        ids, ends = own.encode(pa.array(texts[i : i + 100]))
        for text, part in zip(texts[i : i + 100], np.split(ids, ends[:-1])):
            assert part.tolist() == t.encode(text or "", add_special_tokens=False).ids
    assert len(own.words) <= 50 + 100 * 40


def brute_packing(lengths, capacity):
    """Best-fit decreasing, document by document: how full the bins are."""
    left = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in left if r >= x]
        if fits:
            left[left.index(min(fits))] -= x
        else:
            left.append(capacity - x)
    return sorted(left)


@pytest.mark.parametrize("seed", range(8))
def test_plan_fills_bins_as_best_fit_decreasing(seed):
    rng, capacity = random.Random(seed), rng_capacity(seed)
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 5)), capacity // 3 or 1]) for _ in range(400)]
    counts = {x: lengths.count(x) for x in set(lengths)}
    placed, ranks = {}, {}
    for length, rank, n, each, first, base in packing.plan(counts, capacity):
        for t in range(n):
            placed.setdefault(first + t // each, []).append((base + t % each * length, length))
            ranks.setdefault(length, []).append(rank + t)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(x for _, x in v) for v in placed.values()) == brute_packing(lengths, capacity)


def rng_capacity(seed):
    return [1, 2, 7, 10, 32, 100, 2047, 2048][seed]


def test_packing_of_whole_texts(spark):
    t, texts = library(), ODD * 3
    whole = packing.pieces(docs(spark, texts).repartition(5))
    packed = packing.pack(whole)
    rows = packed.collect()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
        assert r.row == 1 and r["a.b `c`"] == "odd" and r._part == 7
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want = [(n, s, ids[s : s + 2048]) for n, s in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in of[i]) == want
    joined = packing.sequences(packed).collect()
    assert sum(r.length for r in joined) == sum(r.length for r in rows) and max(r.length for r in joined) <= 2048
    assert all(len(r.ids) == 4 * r.length for r in joined) and len(joined) == len(brute_packing([r.length for r in rows], 2048))
    r = rows[0]
    assert next(x.ids for x in joined if x.sequence_id == r.sequence_id)[4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    assert packing.pack(packing.pieces(docs(spark, ODD).limit(0))).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(0,)], "length long"))


def test_packing_query(spark):
    rows = registry.queries()["op11_packing"](spark, DATA).collect()
    t = library()
    for d in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        ids = t.encode(d.text or "", add_special_tokens=False).ids + [0]
        want = [(n, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for n, s in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d.doc_id) == want


# clustering


def brute_clusters(ids, vectors, k, rounds):
    x = np.array(vectors, np.int64)
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"1:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), x[i].tolist()))
    c = x[order[:k]].copy()
    nearest = lambda: ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        a = nearest().argmin(axis=1)
        for j in set(a.tolist()):
            c[j] = [int(s) // int((a == j).sum()) for s in x[a == j].sum(axis=0)]
    d = nearest()
    return d.argmin(axis=1), d.min(axis=1), c


@pytest.mark.parametrize("bits,size,n", [(1, 3, 200), (4, 8, 300), (6, 64, 300), (8, 5, 9)])
def test_clusters_equal_brute_force(spark, bits, size, n):
    rng = np.random.default_rng(bits)
    x = rng.integers(-30, 30, (n, size)) + 40 * rng.integers(0, 4, (n, 1))
    x[: n // 3] = x[0]  # a third of all vectors are equal
    ids = [None if i == 1 else i // 2 if i < 20 else i for i in range(n)]
    rows = [(i, (v / 64).tolist()) for i, v in zip(ids, x.tolist()) for v in [np.array(v)]]
    bad = [(900, None), (901, [None] * size), (902, [float("nan")] * size), (903, [float("inf")] * size), (904, [0.5] * (size + 1)), (905, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit(1), "v": F.lit("x")}).repartition(3)
    found, centres = centroids.clusters(df, dimensions=size, bits=bits)
    cluster, distance, want = brute_clusters(ids, x, 16, 3)
    key = lambda r: tuple(-1 if v is None else int(v) for v in r)
    assert sorted(map(key, found.select("vec_id", "cluster", "distance").collect())) == sorted(map(key, zip(ids, cluster.tolist(), distance.tolist())))
    assert centres == want.tolist()
    none, empty = centroids.clusters(df.where("vec_id >= 900"), dimensions=size)
    assert none.count() == 0 and empty == []


def test_bounds_hold_for_every_cell():
    rng = np.random.default_rng(3)
    x = np.where(rng.random((500, 6)) < 0.05, rng.integers(-(1 << 27), 1 << 27, (500, 6)), rng.integers(-40, 40, (500, 6)))
    for bits in (1, 3, 8):
        cells = centroids.Cells(x[:60], x.min(axis=0), x.max(axis=0), bits)
        at, c = cells.of(x), x[60:70]
        near, far = cells.tables(c)
        apart = (x[:, None] - c[None]) ** 2
        for d in range(6):
            assert (near[d][at[:, d]] <= apart[:, :, d]).all() and (apart[:, :, d] <= far[d][at[:, d]]).all()
        cluster, made = centroids.assign(at, x.astype(np.int32), near, far, c)
        assert (cluster == apart.sum(axis=2).argmin(axis=1)).all() and (made != 1).all()


def test_clustering_query(spark):
    rows = registry.queries()["op12_centroids"](spark, DATA).collect()
    given = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    x = [[math.floor(64 * v) for v in r.embedding] for r in given]
    cluster, distance, c = brute_clusters([r.vec_id for r in given], x, 16, 3)
    digests = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    want = {r.vec_id: (a, d, int(distance[cluster == a].sum()), int(distance.sum()), digests[a]) for r, a, d in zip(given, cluster.tolist(), distance.tolist())}
    assert {r.vec_id: (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows} == want


def test_infill_query_equals_its_sql(spark):
    import duckdb

    rows = registry.queries()["op13_infill"](spark, DATA)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    said = db.execute(registry.oracle_sql()["op13_infill"])
    names = [d[0] for d in said.description]
    assert sorted(map(repr, said.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in rows.collect())
