"""Row numbers within keys of which one may hold most rows, and funnels over users' histories."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.sources.folders import shared


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """df with the number, from 1, of each row among those of its keys in order: what row_number() over the keys gives.

    Rows are cut by count, in the order of keys and order, into a written table; a row's number is its rank inside
    its part and key, plus the key's rows in the parts before. So no task holds more than a part,
    however many rows a key has. Null keys are a key; rows that are equal in order have any of their numbers.
    """
    spark = df.sparkSession
    path = f"{shared(spark)}/ranks-{uuid.uuid4().hex}"
    df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    cut = spark.read.parquet(path)
    own = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    sizes = cut.groupBy("_part", *keys).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = cut.withColumn("_own", own).join(sizes, same)
    return joined.select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def funnel_states(events: DataFrame, user: str, order: list[str], funnels: list[list[Column]], first: dict[str, Column] | None = None) -> DataFrame:
    """(user, reached array<int>, first ones): how many steps of each funnel a user's events reach, in order, an event one step at most.

    All funnels are one automaton over one scan. What a stretch of events does to every state is a
    small array, and arrays of later stretches are applied to those of earlier ones; so events are taken together by
    user and minute, minutes by day, and days by user. No group is longer than a user's events of a minute, the minutes of a day, or the
    user's days. first: columns whose earliest value that is not null is wanted.
    """
    ts = order[0]
    # state number: funnels one after the other, each with its steps and an end
    flags = F.array(*[F.coalesce(c, F.lit(False)) for steps in funnels for c in [*steps, F.lit(False)]])
    size = sum(len(s) + 1 for s in funnels)
    nothing = F.array(*[F.lit(i) for i in range(size)])
    seen = first or {}
    marks = [F.min(F.when(c.isNotNull(), F.struct(*[F.col(o) for o in order], c.alias("value")))).alias(f"_first_{k}") for k, c in seen.items()]
    again = [F.min(f"_first_{k}").alias(f"_first_{k}") for k in seen]
    minute = events.groupBy(user, F.date_trunc("minute", ts).alias("_at")).agg(F.sort_array(F.collect_list(F.struct(*order, flags.alias("_flags")))).alias("_events"), *marks)
    step = lambda state, e: F.transform(state, lambda s: F.when(F.get(e["_flags"], s), s + 1).otherwise(s))
    done = minute.withColumn("_map", F.aggregate("_events", nothing, step))
    for width in ("day", None):
        keys = [user] + ([F.date_trunc(width, "_at").alias("_at")] if width else [])
        parts = done.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("_at").alias("t"), "_map"))).alias("_maps"), *again)
        done = parts.withColumn("_map", F.aggregate("_maps", nothing, lambda state, m: F.transform(state, lambda s: F.get(m["_map"], s))))
    starts = [sum(len(s) + 1 for s in funnels[:k]) for k in range(len(funnels))]
    return done.select(user, F.array(*[F.get("_map", F.lit(at)) - at for at in starts]).alias("reached"), *[F.col(f"_first_{k}.value").alias(k) for k in seen])
