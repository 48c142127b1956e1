"""Streaming counterparts of the message append, conversation sessions and weekly volume.

Each takes a streaming DataFrame. Wall-clock columns are TIMESTAMP_NTZ, which watermarks do
not accept, so event time is cast to TIMESTAMP under a UTC session.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from daytrail.operators.conversation import DOUBLE_TEXT_AFTER_S, SESSION_GAP_S
from daytrail.sources.chats import NATURAL_KEY, append_messages

# The epoch was a Thursday, so Monday weeks start four days later.
WEEK = "7 days"
MONDAY = "4 days"
SESSION_GAP = "6 hours"
# After all that a stream can hold; the row that ends a stream has this time.
END = "9999-01-01"


def stream_append_messages(
    incoming: DataFrame, target: str, checkpoint: str, dedupe_within: bool = False, by: Sequence[str] = ()
) -> DataStreamWriter:
    """Appends each micro-batch to the message table, leaving out what is stored.

    Batches are named after the stream's checkpoint folder and their number, so one that is
    retried after a failure writes over its own rows.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def save(batch: DataFrame, batch_id: int) -> None:
        append_messages(batch.sparkSession, target, batch, dedupe_within, by, f"{stream}-{batch_id}")

    return (
        incoming.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    )


def deduplicated(incoming: DataFrame, delay: str = "1 day", by: Sequence[str] = ()) -> DataFrame:
    """Drops repeats of the natural key that arrive within ``delay``, keeping state bounded."""
    timed = incoming.withColumn("event_time", F.col("timestamp").cast("timestamp"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(
        [*by, *NATURAL_KEY, "text"]
    )


def stream_sessions(
    incoming: DataFrame,
    delay: str = "1 hour",
    gap: str = SESSION_GAP,
    keys: Sequence[str] = ("thread",),
) -> DataFrame:
    """Conversation sessions per thread, emitted once silence and watermark have passed."""
    timed = incoming.withColumn("event_time", F.col("timestamp").cast("timestamp"))
    return (
        timed.withWatermark("event_time", delay)
        .groupBy(*keys, F.session_window("event_time", gap).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("messages"),
            F.max("event_time").alias("last_message"),
        )
        .select(*keys, F.col("w.start").alias("session_start"), "last_message", "messages")
    )


def stream_weekly_volume(
    incoming: DataFrame, delay: str = "1 day", keys: Sequence[str] = ()
) -> DataFrame:
    """Plays per Monday week."""
    timed = incoming.withColumn("event_time", F.col("timestamp").cast("timestamp"))
    return (
        timed.withWatermark("event_time", delay)
        .groupBy(*keys, F.window("event_time", WEEK, startTime=MONDAY).alias("w"))
        .agg(F.count(F.lit(1)).alias("plays"))
        .select(*keys, F.col("w.start").cast("date").alias("week_start"), "plays")
    )


GAP_COLUMNS = "gap_seconds double, reply_delay_seconds double, is_double_text boolean, is_session_start boolean"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Fixed value: threads share so many keyed states. A call for a state costs far more than a row in it,
#: so many short threads cost no more calls than this, and a state holds a small share of the rows.
GAP_BUCKETS = 4096


class MessageGaps(StatefulProcessor):
    """The columns that a message gets from the one before it in its thread.

    A key is a bucket of threads. Messages wait in the state until the watermark says that none can come
    before them; a timer at the earliest of them then hands them out in order. Of those handed out only
    the last one of each thread stays, so a thread keeps one message and those of the last ``delay``.
    """

    def __init__(self, keys: Sequence[str]):
        self._keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        schema = "".join(f"`{k}` string, " for k in self._keys) + "us bigint, id bigint, sender string"
        self._waiting = handle.getListState("waiting", schema)
        self._last = handle.getListState("last", schema)

    def _last_of_each(self) -> dict[tuple, tuple]:
        n = len(self._keys)
        return {r[:n]: r[n:] for r in map(tuple, self._last.get())} if self._last.exists() else {}

    def _due_at(self, rows: list[tuple]) -> None:
        self._handle.registerTimer(min(r[-3] for r in rows) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, due, fresh = len(self._keys), self._last_of_each(), []
        for part in rows:
            threads = zip(*(part[k] for k in self._keys), strict=True)
            for thread, us, msg_id, sender in zip(threads, part["us"], part["msg_id"], part["sender"], strict=True):
                row = (*thread, int(us), int(msg_id), sender)
                if thread not in due or row[n:-1] > due[thread][:2]:  # what is earlier came too late
                    fresh.append(row)
        if fresh:
            self._waiting.appendList(fresh)
            self._due_at(fresh)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, n = timerValues.getCurrentWatermarkInMs(), len(self._keys)
        ready, kept, out = [], [], []
        for row in map(tuple, self._waiting.get()) if self._waiting.exists() else ():
            (kept if row[-3] // 1000 > mark else ready).append(row)
        if not ready:
            return
        ready.sort(key=lambda r: (*r[n:-1], r[-1] is not None, r[-1] or ""))
        lasts = self._last_of_each()
        for row in ready:
            thread, (us, msg_id, sender) = row[:n], row[n:]
            last = lasts.get(thread)
            gap = None if last is None else (us - last[0]) / 1_000_000
            same = last is not None and sender == last[2]
            out.append((
                *row, gap, gap if last is not None and not same else None,
                same and gap > DOUBLE_TEXT_AFTER_S, gap is None or gap > SESSION_GAP_S,
            ))
            lasts[thread] = (us, msg_id, sender)
        self._last.put([(*thread, *last) for thread, last in lasts.items()])
        if kept:
            self._waiting.put(kept)
            self._due_at(kept)
        else:
            self._waiting.clear()
        columns = [*self._keys, "us", "msg_id", "sender", "gap_seconds", "reply_delay_seconds", "is_double_text", "is_session_start"]
        yield pd.DataFrame(out, columns=columns).astype({"gap_seconds": "float64", "reply_delay_seconds": "float64"})

    def close(self) -> None:
        pass


def stream_message_gaps(incoming: DataFrame, delay: str = "1 hour", keys: Sequence[str] = ("thread",)) -> DataFrame:
    """Messages in order of time with gap, reply delay, double text and session start, each once.

    A message comes out when the watermark has passed it; one that arrives later than ``delay`` is
    left out. Appends only: nothing that came out changes. The session must use the state store that
    :data:`STATE_STORE` names.
    """
    timed = incoming.withColumn("event_time", F.col("timestamp").cast("timestamp"))
    # Keys travel as text: pandas has no missing number but NaN.
    slim = timed.withWatermark("event_time", delay).select(
        F.pmod(F.xxhash64(*keys), F.lit(GAP_BUCKETS)).alias("_bucket"), *[F.col(k).cast("string").alias(k) for k in keys],
        "event_time", F.unix_micros("event_time").alias("us"), F.col("msg_id").cast("long").alias("msg_id"), "sender"
    )
    kinds = ", ".join(f"`{k}` string" for k in keys)
    out = slim.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=MessageGaps(keys),
        outputStructType=f"{kinds}, us bigint, msg_id bigint, sender string, {GAP_COLUMNS}",
        outputMode="Append",
        timeMode="EventTime",
    )
    typed = {k: F.col(k).cast(incoming.schema[k].dataType) for k in keys}
    missing = {c: F.when(~F.isnan(c), F.col(c)) for c in ("gap_seconds", "reply_delay_seconds")}
    return out.withColumns(typed | missing).withColumn("timestamp", F.timestamp_micros("us").cast("timestamp_ntz")).drop("us")


def append_to_folder(stream: DataFrame, folder: str) -> DataStreamWriter:
    """Appends what a stream gives, a subfolder a batch, so that a batch sent again replaces itself."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    return stream.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{folder}/state")


def run_available(writer: DataStreamWriter, timeout_s: float | None = None) -> None:
    """Processes everything that is there, however long it takes; raises what the stream raised.

    With ``timeout_s`` a stream that is not done by then is stopped and TimeoutError is raised, so
    that no caller takes a part for the whole.
    """
    query = writer.trigger(availableNow=True).start()
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream was not done after {timeout_s} seconds")


def run_to_end(make: Callable[[DataFrame], DataFrame], incoming: DataFrame, folder: str, time: str = "timestamp") -> None:
    """Appends all that ``make`` gives for a stream that has ended, what its watermark holds back included.

    First everything that is there is processed. Then a row of nulls at :data:`END` moves the watermark
    past all others, which closes their sessions and windows; its own is never closed. Nothing can
    follow it, so the folder and its checkpoint are for this one run.
    """
    spark, ends = incoming.sparkSession, f"{folder}/end"
    last = spark.range(1).select(
        *[F.lit(END if f.name == time else None).cast(f.dataType).alias(f.name) for f in incoming.schema]
    )
    last.limit(0).write.parquet(ends)
    for ended in (False, True):
        if ended:
            last.write.mode("append").parquet(ends)
        both = incoming.unionByName(spark.readStream.schema(last.schema).parquet(ends))
        run_available(append_to_folder(make(both), folder))


def read_message_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream over a folder of Parquet files with the schema of ``like``."""
    return spark.readStream.schema(like.schema).parquet(path)
