"""A table with the latest row of each key, which streams keep up batch by batch.

Keys are dealt to a fixed number of buckets. A batch writes only its own rows (a delta of each bucket that
it touches) and then a small commit: for every bucket its base and the deltas above it. Reading
merges base and deltas by key. A bucket whose deltas have become many is compacted: base and deltas are merged
into a new base, with that batch. Files that the last two commits do not name are deleted.

A batch that is run again, after a failure at any point, starts from the commit before it and overwrites what
it had written. Commits hold a row for each bucket, so that nothing that grows with the table passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS, MOST_DELTAS = 64, 8
COMMIT = "bucket int, base long, deltas array<long>"


class Store:
    """The table at one folder; key and order are columns of schema, and larger orders win (equal ones: the larger row)."""

    def __init__(self, spark: SparkSession, at: str, schema: StructType, key: str, order: str, buckets: int = BUCKETS, most_deltas: int = MOST_DELTAS):
        self.spark, self.at, self.schema, self.key, self.order = spark, at.rstrip("/"), schema, key, order
        self.buckets, self.most_deltas = buckets, most_deltas

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str, prefix: str) -> list[int]:
        path, files = self._path(f"{self.at}/{folder}")
        if not files.exists(path):
            return []
        return sorted(int(s.getPath().getName().removeprefix(prefix)) for s in files.listStatus(path) if s.getPath().getName().startswith(prefix))

    def commits(self) -> list[int]:
        """Numbers of the batches whose commit is whole."""
        done = lambda n: (lambda p, fs: fs.exists(p))(*self._path(f"{self.at}/commits/batch={n}/_SUCCESS"))
        return [n for n in self._names("commits", "batch=") if done(n)]

    def state(self, batch: int) -> dict[int, tuple[int | None, list[int]]]:
        rows = self.spark.read.schema(COMMIT).parquet(f"{self.at}/commits/batch={batch}").collect()
        return {r.bucket: (r.base, list(r.deltas)) for r in rows}

    def _folders(self, state: dict, buckets=None) -> list[str]:
        out = []
        for bucket, (base, deltas) in sorted(state.items()):
            if buckets is None or bucket in buckets:
                out += [f"{self.at}/base/batch={base}/bucket={bucket}"] if base is not None else []
                out += [f"{self.at}/deltas/batch={n}/bucket={bucket}" for n in deltas]
        return out

    def latest(self, rows: DataFrame) -> DataFrame:
        """One row of each key, with its bucket; partial maxima are taken before the shuffle."""
        row = F.struct(*[F.col(c) for c in self.schema.names])
        best = rows.groupBy(self.key).agg(F.max(F.struct(F.col(self.order).alias("o"), row.alias("row"))).alias("best"))
        return best.select("best.row.*").withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.at}/{folder}")

    def merge(self, batch: DataFrame, number: int) -> None:
        """Takes over a batch of rows and commits."""
        before = [n for n in self.commits() if n < number]
        state = self.state(before[-1]) if before else {}
        self._write(self.latest(batch.select(*self.schema.names)), f"deltas/batch={number}")
        touched = self._names(f"deltas/batch={number}", "bucket=")
        for bucket in touched:
            base, deltas = state.get(bucket, (None, []))
            state[bucket] = (base, [*deltas, number])
        full = {b for b in touched if len(state[b][1]) > self.most_deltas}
        if full:
            self._write(self.latest(self._rows(state, full)), f"base/batch={number}")
            state |= {b: (number, []) for b in full}
        commit = self.spark.createDataFrame([(b, base, deltas) for b, (base, deltas) in sorted(state.items())], COMMIT)
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.at}/commits/batch={number}")
        self._clean(before, state)

    def _rows(self, state: dict, buckets=None) -> DataFrame:
        folders = self._folders(state, buckets)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _clean(self, before: list[int], state: dict) -> None:
        """Deletes folders that neither this commit nor the one before it names, and older commits."""
        kept = set(self._folders(state))
        if before:
            kept |= set(self._folders(self.state(before[-1])))
        for kind in ("base", "deltas"):
            for number in self._names(kind, "batch="):
                own = [f"{self.at}/{kind}/batch={number}/bucket={b}" for b in self._names(f"{kind}/batch={number}", "bucket=")]
                gone = [f for f in own if f not in kept]
                for folder in [f"{self.at}/{kind}/batch={number}"] if len(gone) == len(own) else gone:
                    path, files = self._path(folder)
                    files.delete(path, True)
        for number in before[:-1]:
            path, files = self._path(f"{self.at}/commits/batch={number}")
            files.delete(path, True)

    def read(self) -> DataFrame:
        """The latest row of each key."""
        done = self.commits()
        return self.latest(self._rows(self.state(done[-1]) if done else {})).drop("bucket")


def keep_up(stream: DataFrame, store: Store, prepare: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over what there is into the store, each batch prepared before, and returns the table."""

    def merge(batch: DataFrame, number: int) -> None:
        store.merge(prepare(batch, number) if prepare else batch, number)

    stream.writeStream.option("checkpointLocation", f"{store.at}/state").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    return store.read()
