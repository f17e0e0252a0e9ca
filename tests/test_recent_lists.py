"""Lists of the decisive entries equal a replay of all, over batches, with late entries; few of them go to a board's task."""

from __future__ import annotations

import random

import pytest

from larder.streaming import jobs as J

SCHEMA = "board string, member string, id long, at long"


@pytest.mark.parametrize("seed, late", [(1, 0), (2, 0), (3, 90)])
def test_recent_lists_equal_a_replay(spark, tmp_path, seed, late):
    rng, source, out, boards = random.Random(seed), f"file://{tmp_path}/in", f"file://{tmp_path}/out", {}
    for part in range(3):
        rows = [(rng.choice("xyz"), rng.choice("abcdefg"), part * 100 + k, part * (100 - late) + k // 2) for k in range(60)] + [(f"o{part}", "a", 1, 1)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        for board, member, _, at in sorted(rows, key=lambda r: (r[3], r[2])):
            held = boards.setdefault(board, {})
            if len(held) >= 4:
                del held[min(held, key=lambda m: (held[m], m))]
            held[member] = at
        got = J.recent_lists(spark.readStream.schema(SCHEMA).parquet(source), out, most=4, name="recent")
        assert sorted(tuple(r) for r in got.collect()) == sorted((b, m, at) for b, held in boards.items() for m, at in held.items())


def test_few_entries_decide(spark):
    rows = spark.range(5000).selectExpr("'x' as board", "cast(id % 50 as string) as member", "id", "id as at")
    assert J._decisive(rows, 4).count() == 5
