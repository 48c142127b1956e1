"""Streaming jobs run over the events table until it is used up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrail.catalog.registry import register
from daytrail.plans import adapters
from daytrail.session import new_folder
from daytrail.streaming import jobs


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def as_messages(events: DataFrame) -> DataFrame:
    return events.selectExpr(*adapters.items(adapters.MESSAGES))


def as_plays(events: DataFrame) -> DataFrame:
    return events.selectExpr(*adapters.items(adapters.PLAYS))


def drained(stream: DataFrame) -> DataFrame:
    """What a stream has appended once its input is used up and the watermark stands."""
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession)
    jobs.run_available(jobs.append_to_folder(stream, folder))
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").drop("batch")


def drained_to_end(make: Callable[[DataFrame], DataFrame], incoming: DataFrame) -> DataFrame:
    """All that a stream appends when it has ended: what was still open is closed too."""
    spark, folder = incoming.sparkSession, new_folder(incoming.sparkSession)
    jobs.run_to_end(make, incoming, folder)
    return spark.read.schema(make(incoming).schema).parquet(f"{folder}/out").drop("batch")


#: The watermark after the last message, in microseconds: whole milliseconds less the delay.
MARK = "(SELECT epoch_us(MAX(ts)) // 1000 * 1000 - {} * 1000000::BIGINT FROM events)"


@register(
    "stream_appended_messages",
    "SELECT msg_id, network, thread, timestamp, sender, text FROM messages",
    "messages",
)
def stream_appended_messages(spark, sf_dir):
    """Messages appended twice by a stream; the second run finds them all stored."""
    folder = new_folder(spark)
    for run in (1, 2):
        stream = as_messages(event_stream(spark, sf_dir))
        jobs.run_available(
            jobs.stream_append_messages(stream, f"{folder}/table", f"{folder}/state{run}")
        )
    table = spark.read.parquet(f"{folder}/table")
    return table.select("msg_id", "network", "thread", "timestamp", "sender", "text")


@register(
    "stream_sessions",
    """SELECT thread, MIN(timestamp) AS session_start, MAX(timestamp) AS last_message, COUNT(*) AS messages
       FROM talk GROUP BY thread, session_id""",
    "talk",
)
def stream_sessions(spark, sf_dir):
    got = drained_to_end(jobs.stream_sessions, as_messages(event_stream(spark, sf_dir)))
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "last_message")})


@register(
    "stream_weekly_volume",
    "SELECT CAST(date_trunc('week', timestamp) AS DATE) AS week_start, COUNT(*) AS plays FROM plays GROUP BY 1",
    "plays",
)
def stream_weekly_volume(spark, sf_dir):
    return drained_to_end(jobs.stream_weekly_volume, as_plays(event_stream(spark, sf_dir)))


@register(
    "stream_message_gaps",
    f"""SELECT thread, msg_id, timestamp, sender, ROUND(gap_seconds, 3) AS gap_seconds,
          ROUND(reply_delay_seconds, 3) AS reply_delay_seconds, is_double_text, is_session_start
        FROM talk WHERE epoch_ms(timestamp) * 1000 <= {MARK.format(3600)}""",
    "talk",
)
def stream_message_gaps(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    got = drained(jobs.stream_message_gaps(as_messages(event_stream(spark, sf_dir))))
    return got.withColumns({c: F.round(c, 3) for c in ("gap_seconds", "reply_delay_seconds")})
