"""Streams over files give what the batch operators give."""

import time

import pytest
from pyspark.sql import functions as F

from daytrail.operators import behaviour
from daytrail.plans import adapters
from daytrail.sources.chats import NATURAL_KEY
from daytrail.streaming import jobs

SF = "/root/testdata/sf0.001"


def staged(df, path):
    """The table as several files."""
    df.repartition(3).write.parquet(path)
    return path


def collect_stream(df, spark, name, mode="complete"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_append_stream(spark, tmp_path):
    messages = adapters.messages(spark, SF)
    source = staged(messages, str(tmp_path / "in"))
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = jobs.read_message_stream(spark, source, messages)
    jobs.run_available(jobs.stream_append_messages(stream, target, state))
    assert spark.read.parquet(target).count() == messages.count()
    # The same files through a fresh stream add nothing.
    jobs.run_available(jobs.stream_append_messages(stream, target, str(tmp_path / "state2")))
    assert spark.read.parquet(target).count() == messages.count()


def test_weekly_volume_stream(spark, tmp_path):
    plays = adapters.plays(spark, SF)
    source = staged(plays, str(tmp_path / "in"))
    stream = spark.readStream.schema(plays.schema).parquet(source)
    got = collect_stream(jobs.stream_weekly_volume(stream), spark, "weekly")
    batch = behaviour.weekly_volume(plays).select("week_start", "plays")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_session_stream(spark, tmp_path):
    messages = adapters.messages(spark, SF)
    source = staged(messages, str(tmp_path / "in"))
    stream = spark.readStream.schema(messages.schema).parquet(source)
    got = collect_stream(jobs.stream_sessions(stream), spark, "sessions")
    batch = jobs.stream_sessions(messages)
    assert got.count() == batch.count()
    assert got.agg(F.sum("messages")).first()[0] == messages.count()


def test_deduplicated_stream(spark, tmp_path):
    messages = adapters.messages(spark, SF)
    twice = messages.unionByName(messages)
    source = staged(twice, str(tmp_path / "in"))
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 10).parquet(source)
    got = collect_stream(jobs.deduplicated(stream, "40 days"), spark, "unique_messages", "append")
    assert got.select(*NATURAL_KEY, "text").distinct().count() == got.count() == messages.count()


def test_a_stream_that_is_not_done_or_fails_raises(spark, tmp_path):
    messages = adapters.messages(spark, SF)
    source = staged(messages, str(tmp_path / "in"))
    stream = jobs.read_message_stream(spark, source, messages)

    def slow(batch, _id):
        time.sleep(20)

    def broken(batch, _id):
        raise RuntimeError("no")

    for save, error, limit in ((slow, TimeoutError, 1), (broken, Exception, None)):
        writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", str(tmp_path / save.__name__))
        with pytest.raises(error):
            jobs.run_available(writer, limit)
