"""Structured Streaming forms of the gates and upserts.

Event time is cast to TIMESTAMP (the tables hold TIMESTAMP_NTZ, which watermarks reject).
Windows are tumbling; late rows beyond the watermark are dropped, which the batch forms
do not do. State is bounded by the watermark or by a timeout, but for first touches,
which are one row per user by design.
"""

from __future__ import annotations

import heapq
import uuid

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larder.streaming.store import Store, keep_up

MOST_FAILURES, LOCK_SECONDS = 5, 900


def events(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of events, ts as TIMESTAMP; path is a file or a folder (as a pattern, since a stream takes no single file)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def counts(stream: DataFrame, seconds: int, *keys: str) -> DataFrame:
    """Rows per key and tumbling window. In update mode each batch gives the new counts of the windows that it changed; latest() reads them."""
    width = f"{seconds} seconds"
    grouped = stream.withWatermark("ts", width).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("win"), *keys, "n")


def latest(written: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """The last count, which is the largest, of each window and key that counts() wrote, open windows too; over: more than most."""
    rows = written.groupBy("win", *keys).agg(F.max("n").alias("n"))
    return rows if most is None else rows.withColumn("over", F.col("n") > most)


#: Keys of once_a_day() are dealt to so many groups: a call of Python and a row of state for each of them, not for each key.
DEALT = 1024


def once_a_day(stream: DataFrame, first: str, second: str) -> DataFrame:
    """(first, second, taken): a row of a key is taken, at that second, if none of its key was taken in the 24 hours before.

    State is a group's keys with the time last taken, of the last 24 hours before the watermark. Keys travel as strings.
    """
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    day = 86_400_000_000

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        firsts, seconds, lasts = state.get if state.exists else ([], [], [])
        expired = state.getCurrentWatermarkMs() * 1000 - day  # rows are not older than the watermark, so what was taken before that decides nothing
        held = {(f, s): t for f, s, t in zip(firsts, seconds, lasts) if t >= expired}
        rows, taken = pd.concat(list(frames)).sort_values("at"), []
        for f, s, now in zip(rows["first"].tolist(), rows["second"].tolist(), rows["at"].tolist()):
            last = held.get((f, s))
            if last is None or now >= last + day:
                held[f, s] = now
                taken.append((f, s, now // 1_000_000))
        state.update(([f for f, _ in held], [s for _, s in held], list(held.values())))
        state.setTimeoutTimestamp(max((max(held.values()) + day) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(taken, columns=["first", "second", "taken"])

    own = [F.col(c).cast("string").alias(name) for c, name in ((first, "first"), (second, "second"))]
    timed = stream.withWatermark("ts", "24 hours").select(F.pmod(F.xxhash64(first, second), F.lit(DEALT)).alias("dealt"), *own, "ts", F.unix_micros("ts").alias("at"))
    told = timed.groupBy("dealt").applyInPandasWithState(step, "first string, second string, taken long", "firsts array<string>, seconds array<string>, lasts array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select(F.col("first").cast(kinds[first]).alias(first), F.col("second").cast(kinds[second]).alias(second), "taken")


LOCK = "subject string, id long, outcome string, failures int"


def lockouts(stream: DataFrame, most: int = MOST_FAILURES, seconds: int = LOCK_SECONDS) -> DataFrame:
    """What becomes of each attempt (subject string, id long, ts, failed boolean), and the subject's failures after it.

    Failures count from the first one in a row; a success clears them, and so does the time limit from that first
    one. With most failures every attempt is blocked: it neither counts nor clears. State is one row a
    subject with failures, which a timer removes. Attempts of a batch are taken by time and id.
    """

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        n, since = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        told = []
        for now, own, failed in zip(rows["at"], rows["id"], rows["failed"]):
            if n and now >= since + seconds * 1_000_000:
                n = 0
            if n >= most:
                outcome = "blocked"
            elif not failed:
                n, outcome = 0, "cleared"
            else:
                since = since if n else now
                n, outcome = n + 1, "failed"
            told.append((key[0], own, outcome, n))
        if n:
            state.update((n, since))
            state.setTimeoutTimestamp(max(since // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(told, columns=["subject", "id", "outcome", "failures"])

    timed = stream.withWatermark("ts", f"{seconds} seconds").select("subject", "id", "ts", F.unix_micros("ts").alias("at"), F.coalesce("failed", F.lit(False)).alias("failed"))
    return timed.groupBy("subject").applyInPandasWithState(step, LOCK, "n long, since long", "append", GroupStateTimeout.EventTimeTimeout)


#: Fixed value: members that a list holds.
MOST_MEMBERS = 10_000
MEMBERS = "board string, member string, at long, seq long"


def recent_members(stream: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """The members of each board after each batch of entries (board, member, id, at long): (board, member, at, seq).

    An entry puts its member at its time, anew if it is known. Before that, if the board is full, the member of the oldest
    time goes (of equal times the smaller one), also if the entry's member is known, as a store that
    evicts before it adds does. Entries of a batch are taken by time and id. State is a board's members, most at the most; a board's
    entries are one after the other by their meaning. seq counts a board's entries; latest_members() keeps the last list.
    """

    def step(key, frames, state: GroupState):
        names, ats, seq = state.get if state.exists else ([], [], 0)
        held = dict(zip(names, ats))
        heap = [(at, name) for name, at in held.items()]
        heapq.heapify(heap)
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        for at, member in zip(rows["at"].tolist(), rows["member"].tolist()):
            while len(held) >= most:
                oldest, name = heapq.heappop(heap)
                if held.get(name) == oldest:  # else it was added anew since
                    del held[name]
            held[member] = at
            heapq.heappush(heap, (at, member))
            seq += 1
        state.update((list(held), list(held.values()), seq))
        yield pd.DataFrame({"board": [key[0]] * len(held), "member": list(held), "at": list(held.values()), "seq": [seq] * len(held)})

    entries = stream.select("board", "member", "id", "at").where("board is not null and member is not null and at is not null")
    return entries.groupBy("board").applyInPandasWithState(step, MEMBERS, "members array<string>, ats array<long>, seq long", "update", GroupStateTimeout.NoTimeout)


def latest_members(written: DataFrame) -> DataFrame:
    """The last list of each board that recent_members() wrote, the newest first: (board, place, member, at)."""
    last = written.groupBy("board").agg(F.max("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("board").orderBy(F.desc("at"), "member"))  # a bounded list
    return written.join(last, ["board", "seq"]).select("board", place.alias("place"), "member", "at")


LIST = "board string, member string, at long"


def _replay(batches, most: int):
    """Lists (board, member, at) after entries (board, at, id, member) that come by board, the old list first (listed), then by at and id. One list is held."""
    names = ["board", "member", "at"]
    board, held, heap = None, {}, []
    told = lambda: pa.RecordBatch.from_arrays([pa.array([board] * len(held), pa.string()), pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names)
    for batch in batches:
        for own, listed, at, _, member in zip(*(c.to_pylist() for c in batch.columns)):
            if own != board:
                if held:
                    yield told()
                board, held, heap = own, {}, []
            while not listed and len(held) >= most:
                oldest, name = heapq.heappop(heap)
                if held.get(name) == oldest:  # else it was added anew since
                    del held[name]
            held[member] = at
            heapq.heappush(heap, (at, member))
            if len(heap) > 2 * most + 100:
                heap = [(t, m) for m, t in held.items()]
                heapq.heapify(heap)
    if held:
        yield told()


def _decisive(fresh: DataFrame, most: int) -> DataFrame:
    """Of entries that are newer than their board's list, those that decide the next list.

    They are the last entries of the most members of the newest times (with all of equal time), since every other one is evicted or put anew,
    and the entry before it of the board's last member: whether that was still in the list decides if the last entry
    evicts another. (Of a member's entries at one microsecond the last one counts.) Ranks are taken in parts of a board first.
    """
    when = F.struct("at", "id")
    end = fresh.groupBy("board").agg(F.max(F.struct("at", "id", "member")).alias("end")).select("board", "end.*")
    before = fresh.alias("e").join(end.alias("x"), (F.col("e.board") == F.col("x.board")) & (F.col("e.member") == F.col("x.member")) & (F.struct("e.at", "e.id") < F.struct("x.at", "x.id")))
    before = before.groupBy("e.board", "e.member").agg(F.max(F.struct("e.at", "e.id")).alias("w")).select("board", "w.at", "w.id", "member")
    last = fresh.groupBy("board", "member").agg(F.max(when).alias("w")).select("board", "w.at", "w.id", "member").withColumn("part", F.pmod(F.xxhash64("member"), F.lit(64)))
    for keys in (["board", "part"], ["board"]):
        last = last.withColumn("n", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("at")))).where(F.col("n") <= most).drop("n")
    return last.drop("part").unionByName(before)


def recent_lists(stream: DataFrame, folder: str, most: int = MOST_MEMBERS, name: str | None = None) -> DataFrame:
    """The lists (board, member, at) that recent_members() leads to, where a board may have most entries: of a batch only those that decide go to its task.

    Entries not newer than the board's list, of which an earlier batch knew newer ones, are taken one by one. A run of a name goes on with the lists of the last one.
    """
    spark, out = stream.sparkSession, f"{folder}/{name or uuid.uuid4().hex}"
    entries = stream.select("board", "member", "id", "at").where("board is not null and member is not null and at is not null")

    def take(batch: DataFrame, number: int) -> None:
        batch.persist(StorageLevel.DISK_ONLY)
        old = spark.read.schema(LIST).parquet(f"{out}/lists/batch={number - 1}") if number else spark.createDataFrame([], LIST)
        known = old.groupBy("board").agg(F.max("at").alias("newest"))
        dated = batch.join(known, "board", "left")
        late = dated.where("at <= newest").select("board", "at", "id", "member")
        asked = late.unionByName(_decisive(dated.where("newest is null or at > newest").select("board", "at", "id", "member"), most)).withColumn("listed", F.lit(False))
        rows = asked.unionByName(old.withColumn("listed", F.lit(True)).withColumn("id", F.lit(0).cast("long"))).select("board", "listed", "at", "id", "member")
        ordered = rows.repartition("board").sortWithinPartitions("board", F.desc("listed"), "at", "id")
        ordered.mapInArrow(lambda batches: _replay(batches, most), LIST).write.mode("overwrite").parquet(f"{out}/lists/batch={number}")
        batch.unpersist()

    entries.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    lists = spark.read.schema(f"{LIST}, batch int").parquet(f"{out}/lists")
    return lists.join(lists.agg(F.max("batch").alias("batch")), "batch").select("board", "member", "at")


def first_touches(stream: DataFrame) -> DataFrame:
    """The first campaign visit of each user, kept for ever."""
    visits = stream.where("event_type = 'view' and user_id % 3 <> 0")
    return visits.groupBy("user_id").agg(F.min_by("event_id", "ts").alias("event_id"), F.min("ts").alias("touched"))


def finish(stream: DataFrame, folder: str, mode: str = "append", name: str | None = None) -> DataFrame:
    """Runs a stream over what there is and returns the rows that it wrote to folder.

    In complete mode the last batch's table counts. A run of a name goes on where the last one of
    that name ended, and returns the rows of both; without a name it starts anew.
    """
    spark, at = stream.sparkSession, f"{folder}/{name or uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={0 if mode == 'complete' else number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out").drop("batch")


def upsert(stream: DataFrame, folder: str, key: str, order: str, name: str | None = None, **sizes: int) -> DataFrame:
    """A table with the latest row of each key; a batch writes its own rows only. A run of a name goes on with the table of the last one."""
    return keep_up(stream, Store(stream.sparkSession, f"{folder}/{name or uuid.uuid4().hex}", stream.schema, key, order, **sizes))


def extract(stream: DataFrame, folder: str, name: str | None = None, **sizes: int) -> DataFrame:
    """New pages are read by the best layer as they come and saved by page_id, the last one of a page wins.

    A run of a name goes on where the last one ended; without new pages it returns what is saved.
    """
    from larder.operators.pages import best_layer

    recipes = lambda batch, number: best_layer(batch).withColumn("batch", F.lit(number).cast("long"))
    schema = recipes(stream.sparkSession.createDataFrame([], stream.schema), 0).schema
    store = Store(stream.sparkSession, f"{folder}/{name or uuid.uuid4().hex}", schema, "page_id", "batch", **sizes)
    return keep_up(stream, store, recipes).drop("batch")
