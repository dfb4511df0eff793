"""Event streams: fixed-window counters and idle sessions, the same for batch and stream; ingest in batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.functions.text import stripped
from quern.operators.chunking import chunk_table
from quern.operators.layout import MIME, mime_of


def rate_counts(events: DataFrame, window: str = "1 hour", limit: int = 3) -> DataFrame:
    """user_id, bucket (epoch seconds of the window's start), n, limited: events of a user in each fixed window."""
    counted = events.groupBy("user_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").cast("long").alias("bucket"), "n", (F.col("n") > limit).alias("limited"))


def idle_sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """user_id, start and end (epoch seconds of first event, and of last plus the gap), n of each session."""
    found = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"), "n")


def drain(spark: SparkSession, source: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over all there is, into a Parquet table; what it wrote. A restart goes on from the checkpoint."""
    query = source.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def drain_counts(spark: SparkSession, events: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """user_id, bucket, n of a stream of events, to the end of what is there, from a Parquet table that executors write.

    Each batch's counts go to a folder of its number, which a repeated batch overwrites, and are added up when the table is read. No window is
    held open, so an event counts however late it comes, and nothing is dropped. A restart goes on from the checkpoint."""

    def put(batch: DataFrame, number: int) -> None:
        rate_counts(batch).drop("limited").write.mode("overwrite").parquet(f"{path}/batch={number}")

    events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).groupBy("user_id", "bucket").agg(F.sum("n").alias("n"))


def runs(rows: DataFrame, key: str, at: str, idle: int | None, cap: int) -> DataFrame:
    """key, start, last, n: each key's rows in order, cut where one comes idle seconds or more after the last (if given), or cap seconds or more after the first.

    Where a run starts depends on the one before, so a key's rows go by one after the other: each task reads its rows sorted by key and
    time, batch by batch, and holds one run at a time; one very hot key takes as long as its rows, in little memory. at: seconds."""
    ordered = rows.select(F.col(key).cast("long").alias("key"), F.col(at).cast("long").alias("at")).repartition("key").sortWithinPartitions("key", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[int] | None = None
        for batch in batches:
            done = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("at").to_pylist()):
                if now is not None and now[0] == k and t < now[1] + cap and (idle is None or t < now[2] + idle):
                    now[2], now[3] = t, now[3] + 1
                else:
                    if now is not None:
                        done.append(now)
                    now = [k, t, t, 1]
            yield as_batch(done)
        if now is not None:
            yield as_batch([now])

    def as_batch(done: list[list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*done)] if done else [pa.array([], pa.int64())] * 4, ["key", "start", "last", "n"])

    return ordered.where("key IS NOT NULL AND at IS NOT NULL").mapInArrow(run, "key long, start long, last long, n long")


class Runs(StatefulProcessor):
    """runs() for a stream: the run that is open and the times that wait, for each key.

    Times wait until the watermark has passed them, so they are taken in order however they arrive within its delay; a timer stands at the first of
    them, and one at the end of the open run, which is given out then. Each takes all times that are due. A key's state is one run and the times of the delay."""

    def __init__(self, idle: int | None, cap: int) -> None:
        self.idle, self.cap = idle, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "start long, last long, n long")
        self.waiting = handle.getListState("waiting", "at long")

    def ends(self, start: int, last: int) -> int:
        """The first second that doesn't belong to a run any more."""
        return start + self.cap if self.idle is None else min(last + self.idle, start + self.cap)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = [int(t) for batch in rows for t in batch["at"]]
        self.waiting.appendList([(t,) for t in times])
        self.handle.registerTimer(1000 * min(times))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() // 1000
        times = sorted(t for (t,) in self.waiting.get())
        due = [t for t in times if t <= now]
        before = run = list(self.run.get()) if self.run.exists() else None
        done = []
        for t in due:
            if run is not None and t < self.ends(run[0], run[1]):
                run = [run[0], t, run[2] + 1]
            else:
                if run is not None:
                    done.append(run)
                run = [t, t, 1]
        if due:
            self.waiting.put([(t,) for t in times[len(due) :]]) if len(due) < len(times) else self.waiting.clear()
        if len(due) < len(times):
            self.handle.registerTimer(1000 * times[len(due)])
        if run is not None and self.ends(run[0], run[1]) <= now:
            done.append(run)
            run = None
        if run is None:
            self.run.clear()
        elif run != before:
            self.run.update(tuple(run))
            self.handle.registerTimer(1000 * self.ends(run[0], run[1]))
        if done:
            yield pd.DataFrame({"key": [int(key[0])] * len(done), "start": [r[0] for r in done], "last": [r[1] for r in done], "n": [r[2] for r in done]})

    def close(self) -> None:
        pass


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """The store of state that processors with timers need, for the queries started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stream_runs(spark: SparkSession, events: DataFrame, path: str, checkpoint: str, idle: int | None, cap: int, delay: str = "10 minutes") -> DataFrame:
    """The closed runs of a stream of events (user_id, ts), to the end of what is there, from a Parquet table: key, start, last, n, as runs() gives them.

    A run is closed once the watermark, delay behind the latest event, has passed its end; those still open stay in the state for the next start,
    which goes on from the checkpoint. Events without a key or time are left out; those later than the delay are dropped."""
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay).select(F.col("user_id").cast("long").alias("key"), "ts", F.unix_timestamp("ts").alias("at"))
    found = rows.groupBy("key").transformWithStateInPandas(Runs(idle, cap), "key long, start long, last long, n long", "Append", "EventTime")
    with state_in_rocksdb(spark):
        return drain(spark, found, path, checkpoint)


def sessions(events: DataFrame, idle: int = 7 * 86_400, cap: int = 30 * 86_400) -> DataFrame:
    """user_id, start, end, n: a session ends when nothing has come for idle seconds, and cap seconds after it began at the latest."""
    return as_sessions(runs(events.withColumn("s", F.unix_timestamp("ts")), "user_id", "s", idle, cap), idle, cap)


def as_sessions(found: DataFrame, idle: int, cap: int) -> DataFrame:
    return found.select(F.col("key").alias("user_id"), "start", F.least(F.col("last") + idle, F.col("start") + cap).alias("end"), "n")


def lockouts(failures: DataFrame, threshold: int = 5, window: int = 900) -> DataFrame:
    """user_id, start, n, locked_until: failures counted for window seconds from the first; with threshold or more of them, the user is locked for as long from the last one on (else null)."""
    return as_lockouts(runs(failures.withColumn("s", F.unix_timestamp("ts")), "user_id", "s", None, window), threshold, window)


def as_lockouts(found: DataFrame, threshold: int, window: int) -> DataFrame:
    return found.select(F.col("key").alias("user_id"), "start", "n", F.when(F.col("n") >= threshold, F.col("last") + window).alias("locked_until"))


def ingest(docs: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The chunks of a stream of documents (doc_id, text), to the end of what is there: doc_id, ord, content and others, as chunk_table gives them.

    Each batch goes to a folder of its number, which a repeated batch overwrites, so its chunks are there once; a restart goes on after the last
    whole batch, by the checkpoint."""

    def put(batch: DataFrame, number: int) -> None:
        chunk_table(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return docs.sparkSession.read.parquet(path).drop("batch")


def arrivals(spark: SparkSession, folder: str, pattern: str = "*", most: int = 30 << 20, most_video: int = 300 << 20) -> DataFrame:
    """A stream of the files that arrive in a folder, as sources: path, name, kind (video, pdf, office or text), bytes, sha, text and status.

    The type is that of the name (layout.mime_of), text for others. Files over their kind's bytes are rejected as too large; those of text must be UTF-8
    and not blank. A source of text is parsed at once (its text is there); the others are pending, for a parser of their kind."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
    name = F.substring_index("path", "/", -1)
    mime = F.coalesce(mime_of(name), F.lit("text/plain"))
    kind = F.when(mime.startswith("video/"), "video").when(mime == MIME[".pdf"], "pdf").when(mime == "text/plain", "text").otherwise("office")
    rows = files.select("path", name.alias("name"), kind.alias("kind"), F.col("length").alias("bytes"), "content")
    large = F.col("bytes") > F.when(F.col("kind") == "video", most_video).otherwise(most)
    # What isn't UTF-8 doesn't come back the same from a decoding that puts marks for it.
    text = F.when((F.col("kind") == "text") & ~large & F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    blank = F.coalesce(stripped(text) == "", F.lit(False))
    status = F.when(large, "too_large").when((F.col("kind") == "text") & text.isNull(), "not_utf8").when(blank, "empty").when(F.col("kind") == "text", "parsed").otherwise("pending")
    return rows.select("path", "name", "kind", "bytes", F.sha2("content", 256).alias("sha"), F.when(status == "parsed", text).alias("text"), status.alias("status"))
