"""Change tracking over streams of captures and events; each gives what its batch form gives."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from redlake.sources.tables import fresh_path, written

CHANGES = "key long, run long, change string"
STATE = "run long, semantic string, html string"
EVENTS = "key long, run long, kind string"

#: The state store that holds one value a key on disk, with changes by batch.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Folders that a task writes at once; rows are sorted by folder only where it has more.
WRITERS = ("spark.sql.maxConcurrentOutputFileWriters", "16")
#: Event time of runs: a day each, run 0 on the second, as the first watermark is at 0. Sightings may come half a day late, so a run may be spread over two batches.
DAY_MS = 86_400_000
LATE_MS = DAY_MS // 2


class _Changes(StatefulProcessor):
    """The captures of a key, in order of runs, against the last hashes kept."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE, self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values("run", kind="stable")  # of one key in one batch
        last, out = self.last.get() if self.last.exists() else None, []
        for run, semantic, markup in zip(seen.run.tolist(), seen.semantic_sha256, seen.html_sha256, strict=True):
            if last is not None and run <= last[0]:
                out.append((key[0], run, "late"))
                continue
            out.append((key[0], run, "first" if last is None else "content" if last[1] != semantic else "markup" if last[2] != markup else "same"))
            last = (run, semantic, markup)
        self.last.update(last)
        yield pd.DataFrame(out, columns=["key", "run", "change"])

    def close(self) -> None:
        pass


def detect_changes(captures: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """A stream of captures -> a stream of (key, run, change), against one row of state a key.

    A micro-batch may hold several runs of a key. A capture of a run that isn't after the
    key's last is 'late': it is told, and changes nothing. Keys that are not captured for
    forget_ms are forgotten, so the next capture is a first one; without it none are.
    """
    return captures.groupBy("key").transformWithStateInPandas(_Changes(forget_ms), CHANGES, "append", "ProcessingTime" if forget_ms else "None")


class _Presence(StatefulProcessor):
    """A key's last sighting, with a timer for the run in which it would be missed for the last time."""

    def __init__(self, runs: int):
        self.runs = runs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "run long, removed boolean, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        runs = sorted({int(r) for batch in rows for r in batch.run})
        last, removed, timer = self.seen.get() if self.seen.exists() else (None, False, None)
        out = []
        for run in runs:
            if last is not None and run <= last:
                continue
            if last is not None and run - last > self.runs:
                out += [] if removed else [(key[0], last + self.runs, "document_removed")]
                out.append((key[0], run, "document_restored"))
            last, removed = run, False
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = None if removed else (last + self.runs + 1) * DAY_MS - LATE_MS
        if timer is not None:
            self.handle.registerTimer(timer)
        self.seen.update((last, removed, timer))
        yield pd.DataFrame(out, columns=["key", "run", "kind"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        last, _, _ = self.seen.get()
        self.seen.update((last, True, None))
        yield pd.DataFrame([(key[0], last + self.runs, "document_removed")], columns=["key", "run", "kind"])

    def close(self) -> None:
        pass


def presence_changes(captures: DataFrame, runs: int = 2) -> DataFrame:
    """A stream of sightings (key, run) -> a stream of (key, run, kind): removed in the run that is the second in a row without the key, restored when it is seen again.

    Runs are event time, a day each, and the watermark is the latest run. A batch touches the
    keys it sees and those whose timers it passes, no others. Sightings of a run may come in
    the batch after the run's first; later ones are dropped.
    """
    at = F.timestamp_millis((F.col("run") + 1) * DAY_MS)
    timed = captures.select("key", "run", at.alias("at")).withWatermark("at", f"{LATE_MS} milliseconds")
    return timed.groupBy("key").transformWithStateInPandas(_Presence(runs), EVENTS, "append", "EventTime")


def dedupe(events: DataFrame, keys: list[str], time: str, horizon: str) -> DataFrame:
    """The first event of each fingerprint within a horizon; after it a fingerprint may come again, so state stays bounded."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def latest_per_interval(events: DataFrame, key: str, value: str, time: str, order: str, interval: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """(key, start, value): the last value of each key and interval, once the watermark has passed it."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    g = e.groupBy(key, F.window(time, interval).alias("w")).agg(F.max_by(value, F.struct(time, order)).alias(value))
    return g.select(key, F.col("w.start").alias("start"), value)


def replay(spark: SparkSession, df: DataFrame, run: str) -> DataFrame:
    """A table as a stream: files for each value of a column (runs, days: few), as they would arrive.

    One job writes the files of all values; their times are then set in the order of the
    values, which is the order in which a stream takes files up.
    """
    path = fresh_path(spark, "stream")
    with _with(spark, *WRITERS):
        df.withColumn("__run", F.col(run)).hint("rebalance", "__run").write.partitionBy("__run").parquet(path)
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/__run=*/*.parquet")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [(f.getPath().getParent().getName().removeprefix("__run="), f) for f in fs.globStatus(top) or []]
    values = {str(v): i for i, (v,) in enumerate(df.select(run).where(F.col(run).isNotNull()).distinct().orderBy(run).collect(), start=1)}
    now = int(time.time() * 1000)
    for value, f in files:
        fs.setTimes(f.getPath(), now - 1000 * (len(values) - values.get(value, 0)), -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 32).parquet(f"{path}/*")


@contextmanager
def _with(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within hold their state in RocksDB; a query takes the setting over when it starts."""
    with _with(spark, *ROCKSDB):
        yield


def drained(stream: DataFrame, label: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """All that a stream has given up to now, as a table. With a path, a stream that is started again there goes on where it was."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, label)
    with rocksdb(spark):
        q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-state").option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


#: Event ids in a folder of the ledger. They grow with time, so a batch touches the newest folders, and those of what it repeats.
LEDGER_SPAN = 1 << 20
LEDGER = "event_id long, chat_id long"
#: Pairs of a batch that a task holds to make them distinct; a file of pairs, however small, may have many more.
BATCH_ROWS = 1_000_000


def _booked(spark: SparkSession, path: str, buckets: list[int], number: int | None = None) -> DataFrame:
    """The pairs of some folders of the ledger, without those that batch `number` itself or a later one left."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [p for p in (f"{path}/bucket={b}" for b in buckets) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))]
    if not there:
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(f"{LEDGER}, bucket long, batch long").option("basePath", path).parquet(*there)
    return (rows if number is None else rows.where(F.col("batch") < number)).select("event_id", "chat_id")


def book(path: str, pairs: DataFrame, number: int, span: int = LEDGER_SPAN) -> None:
    """Adds the pairs (event_id, chat_id) of a batch to the ledger, those that aren't there, each once.

    The ledger is in folders of event ids, and in them by batch. A batch reads the folders of
    its own events only, and replaces what an attempt at the same batch has left there, so a
    batch that is repeated books nothing more.
    """
    spark, rows = pairs.sparkSession, pairs.select("event_id", "chat_id").where("event_id is not null and chat_id is not null")
    new = written(rows.repartition(max(1, -(-rows.count() // BATCH_ROWS)), "event_id", "chat_id").distinct().withColumn("bucket", F.floor(F.col("event_id") / span)), "batch")
    buckets = [r.bucket for r in new.select("bucket").distinct().collect()]
    left = new.join(_booked(spark, path, buckets, number), ["event_id", "chat_id"], "left_anti").withColumn("batch", F.lit(number).cast("long"))
    with _with(spark, *WRITERS):
        left.write.partitionBy("bucket", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{LEDGER}, bucket long, batch long").option("basePath", path).parquet(path).select("event_id", "chat_id")


def each_batch(stream: DataFrame, path: str, f: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.foreachBatch(f).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()


def deliver_once(stream: DataFrame, path: str | None = None, span: int = LEDGER_SPAN) -> DataFrame:
    """A stream of (event_id, chat_id), repeats and all -> the ledger under `path`, each pair once.

    There is no state but the ledger itself, and a batch reads only the part that its events are in.
    """
    path = path or fresh_path(stream.sparkSession, "ledger")
    each_batch(stream.select("event_id", "chat_id"), f"{path}-stream", lambda batch, number: book(path, batch, number, span))
    return ledger(stream.sparkSession, path)


def presence_by_runs(captures: DataFrame, runs: int = 2, path: str | None = None) -> DataFrame:
    """(key, run, kind) of all that a stream of sightings tells up to its last run; with a path, a second start goes on there."""
    return drained(presence_changes(captures, runs), "presence", path=path)
