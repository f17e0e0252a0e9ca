"""Streams under a name go on where they ended; open windows are counted."""

import datetime

from pyspark.sql import functions as F

from larder.streaming import jobs as J

START = datetime.datetime(2024, 1, 1)


def _put(spark, folder, rows):
    at = [(START + datetime.timedelta(minutes=m), user, kind, n) for m, user, kind, n in rows]
    spark.createDataFrame(at, "ts timestamp, user_id long, event_type string, event_id long").coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder):
    return spark.readStream.schema("ts timestamp, user_id long, event_type string, event_id long").parquet(folder)


def test_counts_go_on(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    run = lambda: J.latest(J.finish(J.counts(_stream(spark, source), 600, "event_type"), out, "update", "counts"), "event_type", most=2)
    rows = lambda df: sorted((r.event_type, r.n, r.over) for r in df.collect())
    _put(spark, source, [(0, 1, "a", 1), (1, 1, "a", 2), (2, 1, "b", 3)])
    assert rows(run()) == [("a", 2, False), ("b", 1, False)]
    assert rows(run()) == [("a", 2, False), ("b", 1, False)]
    _put(spark, source, [(3, 1, "a", 4), (12, 2, "a", 5)])
    assert rows(run()) == [("a", 1, False), ("a", 3, True), ("b", 1, False)]


def test_upsert_goes_on(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    run = lambda: {r.user_id: r.event_id for r in J.upsert(_stream(spark, source), out, "user_id", "event_id", "library").collect()}
    _put(spark, source, [(0, 1, "a", 1), (1, 2, "a", 2)])
    assert run() == {1: 1, 2: 2}
    assert run() == {1: 1, 2: 2}
    _put(spark, source, [(2, 1, "a", 5), (3, 3, "a", 4)])
    assert run() == {1: 5, 2: 2, 3: 4}


def test_first_touches_of_all_batches(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    _put(spark, source, [(5, 1, "view", 9), (6, 3, "view", 1)])
    run = lambda: J.finish(J.first_touches(_stream(spark, source)), out, "complete", "touches").select("user_id", F.col("event_id")).collect()
    assert [tuple(r) for r in run()] == [(1, 9)]
    _put(spark, source, [(1, 1, "view", 4)])
    assert [tuple(r) for r in run()] == [(1, 4)]


def _replay(attempts, most=5, limit=900):
    """Each attempt by hand: (subject, id, outcome, failures)."""
    held, out = {}, []
    for at, own, subject, failed in sorted(attempts):
        n, since = held.get(subject, (0, 0))
        if n and at >= since + limit:
            n = 0
        if n >= most:
            outcome = "blocked"
        elif failed:
            n, since, outcome = n + 1, since if n else at, "failed"
        else:
            n, outcome = 0, "cleared"
        held[subject] = (n, since)
        out.append((subject, own, outcome, n))
    return sorted(out)


def test_lockouts_equal_a_replay(spark, tmp_path):
    import random

    rng, source, out = random.Random(4), f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    attempts, at = [], 0
    run = lambda: sorted(map(tuple, J.finish(J.lockouts(spark.readStream.schema("ts timestamp, id long, subject string, failed boolean").parquet(source)), out, "append", "locks").collect()))
    for part in range(3):  # a run goes on with the state of the one before
        rows = []
        for k in range(60):
            at += rng.choice([0, 20, 60, 200])
            rows.append((at, part * 100 + k, rng.choice("abc"), rng.random() < 0.85))
        spark.createDataFrame([(START + datetime.timedelta(seconds=t), i, s, f) for t, i, s, f in rows], "ts timestamp, id long, subject string, failed boolean").coalesce(1).write.mode("append").parquet(source)
        attempts += rows
        assert run() == _replay(attempts)
    assert {"blocked", "cleared", "failed"} == {o for _, _, o, _ in _replay(attempts)}


def test_lock_ends_with_the_limit_of_the_first_failure(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    rows = [(0, 1, True), (100, 2, True), (200, 3, True), (300, 4, True), (400, 5, True), (500, 6, False), (899, 7, True), (900, 8, False), (901, 9, True)]
    spark.createDataFrame([(START + datetime.timedelta(seconds=t), i, "s", f) for t, i, f in rows], "ts timestamp, id long, subject string, failed boolean").coalesce(1).write.parquet(source)
    told = J.finish(J.lockouts(spark.readStream.schema("ts timestamp, id long, subject string, failed boolean").parquet(source)), out).orderBy("id").collect()
    assert [(r.outcome, r.failures) for r in told] == [("failed", 1), ("failed", 2), ("failed", 3), ("failed", 4), ("failed", 5), ("blocked", 5), ("blocked", 5), ("cleared", 0), ("failed", 1)]


def _files(path):
    import glob

    return glob.glob(f"{path}/**/*.parquet", recursive=True)


def test_store_writes_what_a_batch_changes_and_goes_on(spark, tmp_path):
    from larder.streaming.store import Store

    at = f"{tmp_path}/table"
    store = Store(spark, f"file://{at}", spark.createDataFrame([], "k long, o long, t string").schema, "k", "o", buckets=8, most_deltas=2)
    frame = lambda rows: spark.createDataFrame(rows, "k long, o long, t string")
    rows = lambda: {r.k: (r.o, r.t) for r in store.read().collect()}
    assert rows() == {}
    want = {k: (1, "x" * 50) for k in range(4000)}
    store.merge(frame([(k, *v) for k, v in want.items()]), 0)
    for n in range(1, 7):
        new = {k: (n + 1, f"batch {n}") for k in range(n * 40, n * 40 + 40)}
        store.merge(frame([(k, *v) for k, v in new.items()] + [(k, 0, "late") for k in new] + [(n, -1, "late")]), n)
        want |= new
        assert rows() == want
        if n == 1:
            assert spark.read.parquet(f"file://{at}/deltas/batch={n}").count() == len({*new, n})  # 1 % of the keys
    assert store.commits() == [5, 6] and all(len(d) <= 2 for _, d in store.state(6).values())
    kept = {f.split("batch=")[1].split("/")[0] for f in _files(f"{at}/deltas")}
    assert "0" not in kept
    # a batch that is run again, also after a failure before its commit, gives the same table
    store.merge(frame([(1, 99, "again")]), 7)
    (tmp_path / "table/commits/batch=7/_SUCCESS").unlink()
    assert rows() == want
    store.merge(frame([(1, 99, "again")]), 7)
    store.merge(frame([(1, 99, "again")]), 7)
    assert rows() == want | {1: (99, "again")}


def test_pages_are_extracted_under_a_name(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    put = lambda rows: spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.mode("append").parquet(source)
    page = lambda title: f"<h1>{title}</h1><h2>Ingredients</h2><ul><li>egg</ul>"
    run = lambda: {r.page_id: r.title for r in J.extract(spark.readStream.schema("page_id long, html string").parquet(source), out, "pages", buckets=4).collect()}
    put([(1, page("A")), (2, "<p>nothing"), (3, page("C"))])
    assert run() == {1: "A", 3: "C"} and run() == {1: "A", 3: "C"}
    put([(3, page("D")), (4, page("E"))])
    assert run() == {1: "A", 3: "D", 4: "E"}
    (tmp_path / "none").mkdir()
    none = spark.readStream.schema("page_id long, html string").parquet(f"file://{tmp_path}/none")
    assert J.extract(none, out).count() == 0


def test_recent_members_equal_a_replay(spark, tmp_path):
    import random

    rng, source, out = random.Random(3), f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "board string, member string, id long, at long"
    run = lambda: sorted((r.board, r.member, r.at) for r in J.latest_members(J.finish(J.recent_members(spark.readStream.schema(schema).parquet(source), most=4), out, "update", "recent")).collect())
    boards = {}
    for part in range(3):
        rows = [(rng.choice("xxy"), rng.choice("abcdefg"), part * 100 + k, part * 1000 + rng.randrange(20)) for k in range(25)] + [(None, "a", 1, 1), ("x", None, 2, 2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for board, member, _, at in sorted((r for r in rows if r[0] and r[1]), key=lambda r: (r[3], r[2])):
            held = boards.setdefault(board, {})
            if len(held) >= 4:
                del held[min(held, key=lambda m: (held[m], m))]
            held[member] = at
        assert run() == sorted((b, m, at) for b, held in boards.items() for m, at in held.items())
