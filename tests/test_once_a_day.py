"""Keys are dealt to groups; each key is still held against its own times, over batches and with nulls."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from larder.streaming import jobs as J


def test_many_keys_share_a_call_of_python(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "DEALT", 2)  # fails where every key is a group of its own: there is nothing to set
    rng, source, out = random.Random(5), f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema, day, begin = "who long, kind string, ts timestamp", timedelta(days=1), datetime(2024, 1, 1)
    run = lambda: J.finish(J.once_a_day(spark.readStream.schema(schema).parquet(source), "who", "kind"), out, name="once")
    last, taken = {}, []
    for part in range(3):
        rows = [(rng.choice([1, 2, 2**60 + 1, None]), rng.choice(["a", "b", None]), begin + part * timedelta(days=4) + timedelta(minutes=rng.randrange(4 * 1440))) for _ in range(150)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for who, kind, at in sorted(rows, key=lambda r: r[2]):
            if (who, kind) not in last or at >= last[who, kind] + day:
                last[who, kind] = at
                taken.append((who, kind, int((at - datetime(1970, 1, 1)).total_seconds())))
        got = run()
        assert got.schema.simpleString() == "struct<who:bigint,kind:string,taken:bigint>"
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, taken))
