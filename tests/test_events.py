"""Ranks of keys that hold most rows, and funnels, against plain code."""

import datetime
import random

from pyspark.sql import functions as F

from larder.functions.dialect import SPARK
from larder.operators.ranks import funnel_states, ranked
from larder.plans.events import first_touch_sql

START = datetime.datetime(2024, 1, 1)


def test_ranks_equal_row_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(3), i, rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, g int, i long, o double").repartition(5)
    got = {r.i: r.n for r in ranked(df, ["k", "g"], ["o", "i"]).collect()}
    want, counts = {}, {}
    for k, g, i, o in sorted(rows, key=lambda r: (r[3], r[2])):
        counts[k, g] = want[i] = counts.get((k, g), 0) + 1
    assert got == want
    assert ranked(df.limit(0), ["k"], ["o"]).count() == 0


def test_funnels_equal_a_replay(spark):
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        at = START + datetime.timedelta(seconds=rng.choice([60, 3600, 86400]) * rng.randrange(40) + rng.randrange(3))
        rows.append((rng.randrange(12) if rng.random() < 0.7 else 99, at, i, rng.choice("abcd")))
    funnels = ["abcda", "dc", "aaab"]
    df = spark.createDataFrame(rows, "u long, ts timestamp, i long, kind string")
    states = funnel_states(df, "u", ["ts", "i"], [[F.col("kind") == s for s in f] for f in funnels], {"first_d": F.when(F.col("kind") == "d", F.col("i"))})
    got = {r.u: (list(r.reached), r.first_d) for r in states.collect()}
    want = {}
    for u, _, i, kind in sorted(rows, key=lambda r: (r[1], r[2])):
        reached, first = want.get(u, ([0] * len(funnels), None))
        reached = [n + (n < len(f) and f[n] == kind) for n, f in zip(reached, funnels)]
        want[u] = (reached, i if first is None and kind == "d" else first)
    assert got == want


def test_first_touches(spark):
    long = "x" * 300
    rows = [
        (1, 0, 1, "https://a/x?y=1"), (1, 1, 2, "https://a/deep/path?utm_source=reddit&utm_medium=a%20b+c&utm_campaign=first#f"), (1, 2, 3, "https://a/?utm_source=tiktok"),
        (2, 0, 4, "https://a/?utm_source=&xutm_source=no"), (3, 0, 5, f"https://a?utm_term={long}&utm_term=second"), (4, 0, 6, "https://a/#?utm_source=no"), (5, 0, 7, None),
    ]
    spark.createDataFrame([(u, START + datetime.timedelta(seconds=t), e, a) for u, t, e, a in rows], "user_id long, ts timestamp, event_id long, address string").createOrReplaceTempView("visits_given")
    got = {r.user_id: r for r in spark.sql(first_touch_sql(SPARK, "select * from visits_given")).collect()}
    assert set(got) == {1, 3}
    assert (got[1].first_utm_source, got[1].first_utm_medium, got[1].first_utm_campaign, got[1].first_utm_term, got[1].first_landing_path) == ("reddit", "a b c", "first", None, "/deep/path")
    assert got[3].first_utm_term == "x" * 200 and got[3].first_landing_path == "" and got[1].first_touch_at == START + datetime.timedelta(seconds=1)
