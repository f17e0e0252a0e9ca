"""The pipeline's stages against brute force on the smallest tables."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as C
from larder.llm import language, similar
from larder.llm.staging import stage

DATA = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def firsts_of_groups(texts):
    sets, holders = {k: shingles(t) for k, t in texts.items()}, defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    parent = {k: k for k in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {(v[j], v[i]) for v in holders.values() for i in range(len(v)) for j in range(i)}:
        common = len(sets[a] & sets[b])
        if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {find(k) for k in sets}


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "a@b.cd " + "the of and " * 9, None, "s", 1)], docs.schema)
    now = stage(docs.unionByName(odd), "docs")
    known = stage(C.STAGES[0][1](spark, now, DATA), "language")
    assert {r.doc_id for r in now.collect()} - {r.doc_id for r in known.collect()} == {-1, -2}
    assert known.columns == now.columns and known.where("lang is null").count() == 0
    kept = stage(C.STAGES[1][1](spark, known, DATA), "near")
    assert {r.doc_id for r in kept.collect()} == firsts_of_groups({r.doc_id: r.text for r in known.collect()})
    clean = stage(C.STAGES[2][1](spark, kept, DATA), "clean")
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaky = {r.doc_id for r in kept.collect() if any(i in " ".join(r.text.lower().split()) for i in items)}
    assert leaky and {r.doc_id for r in clean.collect()} == {r.doc_id for r in kept.collect()} - leaky
    private = stage(C.STAGES[3][1](spark, clean, DATA), "private")
    assert private.columns == now.columns and private.where("doc_id = -3").first().text.startswith("[email] the")
    assert private.where(r"text rlike '[a-z0-9]@mail[0-9]'").count() == 0
    assert C.STAGES[4][1](spark, private, DATA).where("n_tokens > 0").count() == private.count()


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    told = language.predict(docs.where(language.held_out()), language.train(docs.where(~language.held_out())))
    assert told.where("lang = lang_pred").count() >= 0.95 * told.count()


def test_near_copies_between_many_rows_of_one_bucket(spark):
    frame = [f"f{i}" for i in range(348)]
    own = [[f"u{k}_{i}" for i in range(52)] for k in range(300)]
    planted = {k + 300: own[k][:16] + [f"v{k}_{i}" for i in range(36)] for k in range(10, 300, 6)}
    texts = {k: " ".join(frame + words) for k, words in [*enumerate(own), *planted.items()]}
    sets = {k: shingles(t) for k, t in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert {(a, b) for a in sets for b in sets if a < b and alike(a, b)} == {(k - 300, k) for k in planted}
    df = spark.createDataFrame([(k, k, t) for k, t in texts.items()], "rid long, doc_id long, text string")
    got = {r.rid: r.first_rid for r in similar.similar_groups(df).collect()}
    assert got == {k: k - 300 if k in planted else k for k in texts}


def test_crossing_loses_no_pair(spark):
    rng = random.Random(5)
    sets = {}
    for k in range(150):
        base = set(sets[rng.randrange(k)]) if k and rng.random() < 0.7 else {rng.randrange(60) for _ in range(rng.randrange(1, 40))}
        sets[k] = sorted(base ^ {rng.randrange(60) for _ in range(rng.randrange(4))}) or [0]
    for similarity in (0.5, 0.8, 1.0):
        first = {k: v[: similar.first_size(len(v), similarity)] for k, v in sets.items()}
        df = spark.createDataFrame([(k, k % 3, t, len(sets[k]), v[-1]) for k, v in first.items() for t in v], "rid long, root long, token long, size long, last long")
        got = {(min(r.x, r.y), max(r.x, r.y)) for r in similar.crossing(df, similarity).collect()}
        want = {(a, b) for a in sets for b in sets if a < b and a % 3 != b % 3 and len({*sets[a]} & {*sets[b]}) >= similarity * len({*sets[a]} | {*sets[b]})}
        assert want and want <= got


@pytest.mark.parametrize(("held", "frequent", "rounds"), [(1 << 20, 32, 3), (50, 2, 0), (300, 0, 1)])
def test_groups_equal_brute_force_whatever_the_limits(spark, monkeypatch, held, frequent, rounds):
    monkeypatch.setattr(similar, "HELD", held)
    monkeypatch.setattr(similar, "BLOCK", held)
    monkeypatch.setattr(similar, "FREQUENT", frequent)
    monkeypatch.setattr(similar, "ROUNDS", rounds)
    monkeypatch.setattr(similar, "TOGETHER", 3)
    rng = random.Random(held)
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=rng.randrange(4, 60))) for _ in range(40)]
    for _ in range(160):
        w = rng.choice(texts).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgh")
        texts.append(" ".join(w[rng.randrange(min(3, len(w))) :]))
    texts += [texts[3], texts[3], None, "", " ", "one", "One", "one two"]
    rows = stage(spark.createDataFrame([(k, f"id{k:03}", t) for k, t in enumerate(texts)], "rid long, doc_id string, text string"), "rows")
    got = {r.rid: r.first_rid for r in similar.similar_groups(rows).collect()}
    assert {k for k, v in got.items() if k == v} == firsts_of_groups(dict(enumerate(texts))) and set(got) == set(range(len(texts)))


def test_near_duplicates_keep_odd_rows_as_they_are(spark):
    rows = [("b", "x " * 9 + "tail", 77, "k"), ("b", "x " * 9 + "tail", 77, "k"), (None, "x " * 9 + "tail", 1, "k"), ("a", None, 2, "k"), (None, "", 3, "k"), ("z", "other words stand here now", 4, None)]
    table = spark.createDataFrame(rows, "doc_id string, text string, rid int, `my col` string")
    kept = C.drop_near_duplicates(spark, table, DATA)
    assert kept.columns == table.columns
    assert sorted((r.doc_id or "", r.rid, r["my col"]) for r in kept.collect()) == [("a", 2, "k"), ("b", 77, "k"), ("z", 4, None)]
    assert C.drop_near_duplicates(spark, table.limit(0), DATA).count() == 0


def test_stages_leave_columns_of_other_names_alone(spark):
    text = "the of and to in that is was he for it with as his on be at by "
    own = {"rid": 7, "score": 0.9, "lang_pred": "x", "leaks": "l", "spans": "s", "row": "r", "IDS": 5, "my col": "c", "a.b": "d"}
    rows = [(f"id{k}", text + f"mail a{k}@b.cd", "en", "s", 1, *own.values()) for k in range(3)] + [("none", None, None, None, None, *own.values())]
    names = ["doc_id", "text", "lang", "source", "n_chars", *own]
    kinds = ["string", "string", "string", "string", "long", "long", "double", *["string"] * 4, "long", "string", "string"]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
    for _, function in C.STAGES[:-1]:
        docs = stage(function(spark, docs, DATA), "odd")
        assert docs.columns == names
        for r in docs.collect():
            assert {k: r[k] for k in own} == own
        empty = function(spark, docs.limit(0), DATA)
        assert empty.columns == names and empty.count() == 0
    assert [r.text for r in docs.collect()] == [text + "mail [email]"]
    last = C.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == 1 and C.STAGES[-1][1](spark, docs.limit(0), DATA).count() == 0


def test_counts_of_shared_shingles_come_once_a_row_however_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(similar, "HELD", 300)
    rng = random.Random(3)
    texts = {k: " ".join(rng.choices("abcdefgh", k=rng.randrange(1, 90))) for k in range(120)}
    rows = stage(spark.createDataFrame(list(texts.items()), "rid long, text string").repartition(3), "rows")
    counted = {k: set(similar.counted(similar.shingle_set(t, 5)).tolist()) for k, t in texts.items()}
    n = Counter(t for own in counted.values() for t in own)
    want = {k: shared for k, own in counted.items() if (shared := sum(n[t] > 1 for t in own))}
    for buckets in (1, 40):
        blocks, shared = similar.partners(rows, buckets, 5)
        plan = shared._jdf.queryExecution().executedPlan().toString()
        assert {r.rid: r.n for r in shared.collect()} == want and shared.count() == len(want)
        assert "[bucket" in plan and "[base" in plan and "hashpartitioning(rid" not in plan


def test_edited_copies_of_one_text_are_not_paired_with_each_other(spark, monkeypatch):
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(150)]
    texts = {}
    for k in range(200):
        w = list(passage)
        for i in rng.sample(range(150), rng.randrange(7)):
            w[i] = f"e{k}_{i}"
        texts[k] = " ".join(w)
    asked = []

    def crossing(met, similarity, real=similar.crossing):
        asked.append(real(met, similarity).count())
        return real(met, similarity)

    monkeypatch.setattr(similar, "crossing", crossing)
    df = stage(spark.createDataFrame([(k, k, t) for k, t in texts.items()], "rid long, doc_id long, text string"), "rows")
    got = {r.rid: r.first_rid for r in similar.similar_groups(df).collect()}
    assert {k for k, v in got.items() if k == v} == firsts_of_groups(texts) and len(got) == 200
    assert asked[0] <= len(texts)
