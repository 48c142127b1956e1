"""Conversation sessions as stored tables that late messages change only where they must.

``rows`` holds every message with its session columns and the instant its session starts, by month;
``sessions`` holds one row per session. A late message can lengthen a session, join two, or open one;
besides those, only the opener of the session that follows sees another message before it. So an
update finds the sessions that the late messages touch, on the table of sessions alone, reads those
sessions' messages and the last message before each, works out their columns again, and writes the
months that they lie in. Everything else stays as it was written.

An update may be repeated: messages that are stored already, by ``id``, are left out, and both tables
are written whole months at a time from tables that were made before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daytrail.functions import dates
from daytrail.operators.conversation import SESSION_GAP_S, conversation_columns
from daytrail.plans.ranking import large, over
from daytrail.session import cut_lineage

COLUMNS = ("gap_seconds", "reply_delay_seconds", "is_double_text", "is_session_start", "session_id")
GAP_US = SESSION_GAP_S * 1_000_000


def _month(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM")


def with_session_start(messages: DataFrame, keys: Sequence[str], id: str = "msg_id") -> DataFrame:
    """Session columns, and ``session_us``: when the session of a message starts."""
    talk = conversation_columns(messages, keys, [F.col("timestamp"), F.col(id)], "session_us")
    # Messages without a time or a thread are in no session.
    return talk.filter(F.col("session_id").isNotNull())


def session_table(rows: DataFrame, keys: Sequence[str], id: str = "msg_id") -> DataFrame:
    """(keys, session_us, end_us, messages, last): one row per session; ``last`` is its last message."""
    us = dates.epoch_micros(F.col("timestamp"))
    return rows.groupBy(*keys, "session_us").agg(
        F.max(us).alias("end_us"), F.count(F.lit(1)).alias("messages"),
        F.max(F.struct("timestamp", F.col(id).alias("id"), "sender")).alias("last"),
    )


def _save(rows: DataFrame, sessions: DataFrame, path: str) -> None:
    for name, df in (("rows", rows), ("sessions", sessions)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{path}/{name}")


def store_sessions(messages: DataFrame, path: str, keys: Sequence[str] = ("thread",), id: str = "msg_id") -> None:
    """Writes both tables for messages that have a time and a thread."""
    rows = cut_lineage(with_session_start(messages, keys, id).drop("session_id"))
    by_month = rows.withColumn("month", F.date_format("timestamp", "yyyy-MM"))
    _save(by_month, session_table(rows, keys, id).withColumn("month", _month(F.col("session_us"))), path)


def stored_sessions(spark: SparkSession, path: str, keys: Sequence[str] = ("thread",)) -> DataFrame:
    """The stored messages with all session columns; sessions are numbered from their own table."""
    rows = spark.read.parquet(f"{path}/rows").drop("month")
    sessions = spark.read.parquet(f"{path}/sessions")
    # A thread has four sessions a day at most.
    number = F.row_number().over(over(keys, F.col("session_us"))).cast("long")
    numbered = sessions.select(*keys, "session_us", number.alias("session_id"))
    return rows.join(large(numbered), [*keys, "session_us"]).drop("session_us")


def affected(sessions: DataFrame, late: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, session_us, end_us, last, role): stored sessions that late ones touch (``again``), or
    follow directly (``before``: only their last message matters).

    ``late``: keys, session_us, end_us of the late messages' own sessions. Windows run over the
    sessions of a thread, of which there are four a day at most in either table.
    """
    both = sessions.select(*keys, "session_us", "end_us", "last", F.lit(False).alias("late")).unionByName(
        late.select(*keys, "session_us", "end_us", F.lit(None).cast(sessions.schema["last"].dataType).alias("last"), F.lit(True).alias("late"))
    )
    along = over(keys, F.col("session_us"), F.col("late"))
    reach = F.max("end_us").over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = reach.isNull() | (F.col("session_us") - reach > GAP_US)
    marked = both.withColumn("fresh", fresh.cast("int")).withColumn("group", F.sum("fresh").over(along))
    whole = over([*keys, "group"])
    marked = marked.withColumn("hit", F.max("late").over(whole))
    # A group without late messages is one stored session.
    after_hit = F.coalesce(F.lag("hit").over(along), F.lit(False))
    before_hit = F.coalesce(F.lead("hit").over(along), F.lit(False))
    role = F.when(F.col("hit") | after_hit, F.lit("again")).when(before_hit, F.lit("before"))
    return marked.withColumn("role", role).filter(~F.col("late") & F.col("role").isNotNull()).select(
        *keys, "session_us", "end_us", "last", "role"
    )


def _months(df: DataFrame, *instants: Column) -> list[str]:
    """The months between each row's instants; a bounded number of names."""
    month = F.explode(F.sequence(
        F.date_trunc("month", F.timestamp_micros(instants[0])), F.date_trunc("month", F.timestamp_micros(instants[-1])), F.expr("INTERVAL '1' MONTH")
    ))
    return [r["m"] for r in df.select(month.alias("m")).select(F.date_format("m", "yyyy-MM").alias("m")).distinct().collect()]


def add_late_messages(
    spark: SparkSession, path: str, late: DataFrame, keys: Sequence[str] = ("thread",), id: str = "msg_id"
) -> None:
    """Brings both tables up to date with messages that arrived late, or again."""
    keys = list(keys)
    us = dates.epoch_micros(F.col("timestamp"))
    rows, sessions = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/sessions")
    columns = [c for c in rows.columns if c not in (*COLUMNS, "session_us", "month")]
    months = _months(late, us)
    stored = rows.filter(F.col("month").isin(months)).select(*keys, id)
    fresh = cut_lineage(late.select(*columns).dropDuplicates([*keys, id]).join(large(stored), [*keys, id], "left_anti"))
    if fresh.isEmpty():
        return
    own = session_table(with_session_start(fresh, keys, id), keys, id)
    met = cut_lineage(affected(sessions, own, keys))
    again = large(met.filter("role = 'again'").select(*keys, "session_us"))
    months = sorted({*_months(met.filter("role = 'again'"), F.col("session_us"), F.col("end_us")), *_months(fresh, us)})
    here = rows.filter(F.col("month").isin(months))
    touched = here.join(again, [*keys, "session_us"], "left_semi").select(*columns)
    # The last message before each recomputed stretch; it has no id, so it is told apart afterwards.
    context = met.filter("role = 'before'").select(
        *keys, F.col("last.timestamp").alias("timestamp"), F.col("last.sender").alias("sender"), F.lit(True).alias("_context")
    )
    work = touched.unionByName(fresh.select(*columns)).withColumn("_context", F.lit(False)).unionByName(
        context, allowMissingColumns=True
    )
    talk = with_session_start(work, keys, id).filter("NOT _context").drop("_context", "session_id")
    # A recomputed stretch begins after a silence, so no session reaches into its context.
    redone = cut_lineage(talk)
    kept = here.join(again, [*keys, "session_us"], "left_anti").select(*redone.columns)
    all_rows = kept.unionByName(redone).withColumn("month", F.date_format("timestamp", "yyyy-MM"))
    new_sessions = session_table(redone, keys, id).withColumn("month", _month(F.col("session_us")))
    session_months = sorted({
        *_months(again, F.col("session_us")), *_months(new_sessions, F.col("session_us")),
    })
    old_sessions = sessions.filter(F.col("month").isin(session_months)).join(again, [*keys, "session_us"], "left_anti")
    _save(cut_lineage(all_rows), cut_lineage(old_sessions.select(*new_sessions.columns).unionByName(new_sessions)), path)
