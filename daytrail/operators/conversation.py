"""From parsed messages to message rows: direction, contact, delays and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrail.functions import dates, text
from daytrail.plans.ordered import hour_chunk, ordered_pass, range_chunk
from daytrail.plans.ranking import over, with_group_row

# When a follow-up counts as a double text, and when a session ends.
DOUBLE_TEXT_AFTER_S = 5 * 60
SESSION_GAP_S = 6 * 3600
REACTION_SEPARATOR = ","


def conversation_columns(
    messages: DataFrame,
    thread_keys: Sequence[str] = ("thread",),
    order: Sequence[Column] | None = None,
    start: str | None = None,
) -> DataFrame:
    """Adds gap, reply delay, double text and session columns along each thread.

    A thread of any length is worked off in hourly chunks: inside a chunk by windows, between
    chunks by a table with one row per thread and hour. That row holds the chunk's first and
    last message and how many sessions open inside it, so one pass yields both the neighbour
    of a chunk's first message and the running session number. ``order`` must be total within
    a thread; it defaults to ``timestamp`` and ``msg_id``. ``start`` names one more column: when the
    message's session starts, in microseconds.
    """
    order = list(order or [F.col("timestamp"), F.col("msg_id")])
    cut = [*thread_keys, "_chunk"]
    us = dates.epoch_micros(F.col("timestamp"))
    local = over(cut, *order)
    chunked = messages.withColumns({"_chunk": hour_chunk(F.col("timestamp")), "_us": us})
    inside = chunked.withColumns(
        {"_prev_us": F.lag("_us").over(local), "_prev_sender": F.lag("sender").over(local)}
    )

    def opens(before: Column, now: Column) -> Column:
        return before.isNull() | ((now - before) / F.lit(1_000_000.0) > SESSION_GAP_S)

    # A chunk's first message counts as an opener here; what it is follows between chunks.
    inside = inside.withColumn("_opens", opens(F.col("_prev_us"), F.col("_us")).cast("long"))
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    # Instants grow along a thread, so the last opener is the greatest. Heads are told between chunks.
    opener = F.when(F.col("_prev_us").isNotNull() & (F.col("_opens") == 1), F.col("_us"))
    running = {"_run": F.sum("_opens").over(upto)} | ({"_open_us": F.max(opener).over(upto)} if start else {})
    inside = inside.withColumns(running)

    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    across = over(thread_keys, F.col("_chunk"))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    opened, carried = [], []
    if start:
        opened = [F.max(opener).alias("_last_open")]
        newest = F.coalesce("_last_open", F.when(F.col("_fresh"), F.col("_first_us")))
        carried = [F.when(F.col("_fresh"), F.col("_first_us")).otherwise(F.max(newest).over(earlier)).alias("_base_open")]
    chunks = (
        inside.groupBy(*cut)
        .agg(
            F.min("_us").alias("_first_us"),
            F.max("_us").alias("_last_us"),
            F.max_by("sender", place).alias("_last_sender"),
            F.sum("_opens").alias("_sessions"),
            *opened,
        )
        .withColumns(
            {
                "_from_us": F.lag("_last_us").over(across),
                "_from_sender": F.lag("_last_sender").over(across),
            }
        )
        .withColumn("_fresh", opens(F.col("_from_us"), F.col("_first_us")))
        .withColumn("_own", F.col("_sessions") - F.when(F.col("_fresh"), 0).otherwise(1))
        .withColumn(
            "_base",
            F.coalesce(F.sum("_own").over(earlier), F.lit(0)),
        )
        .select(*cut, "_from_us", "_from_sender", "_fresh", "_base", *carried)
    )
    joined = inside.join(chunks, cut, "left")
    head = F.col("_prev_us").isNull()
    prev_us = F.coalesce("_prev_us", "_from_us")
    same = F.when(head, F.col("_from_sender") == F.col("sender")).otherwise(
        F.col("_prev_sender") == F.col("sender")
    )
    gap = (F.col("_us") - prev_us) / F.lit(1_000_000.0)
    starts = F.when(head, F.col("_fresh")).otherwise(F.col("_opens") == 1)
    number = F.col("_base") + F.col("_run") - F.when(F.col("_fresh"), 0).otherwise(1)
    return joined.select(
        *messages.columns,
        gap.alias("gap_seconds"),
        F.when(~same, gap).alias("reply_delay_seconds"),
        F.coalesce(same & (gap > DOUBLE_TEXT_AFTER_S), F.lit(False)).alias("is_double_text"),
        starts.alias("is_session_start"),
        number.alias("session_id"),
        *([F.coalesce("_open_us", "_base_open").alias(start)] if start else []),
    )


def owner_names(
    threads: DataFrame, messages: DataFrame, by: Sequence[str] = ("source_id",)
) -> DataFrame:
    """Whose export it is, per ``by``: the name present in most threads, then the one with
    most messages, then the one listed earliest."""
    listed = threads.select(
        *by, "thread_key", F.posexplode("participants").alias("_pos", "name")
    )
    presence = listed.groupBy(*by, "name").agg(
        F.countDistinct("thread_key").alias("_threads"), F.min("_pos").alias("_pos")
    )
    written = messages.groupBy(*by, F.col("sender").alias("name")).agg(
        F.count(F.lit(1)).alias("_sent")
    )
    votes = presence.join(written, [*by, "name"], "left")
    rank = F.struct(
        F.col("_threads"), F.coalesce("_sent", F.lit(0)).alias("_sent"), (-F.col("_pos")).alias("_p"), "name"
    )
    return votes.groupBy(*by).agg(F.max(rank)["name"].alias("self_name"))


def reported_owner(
    messages: DataFrame, owners: DataFrame, by: Sequence[str] = ("source_id",),
    per: Sequence[str] = ("network",),
) -> DataFrame:
    """The owner name of the export that carried most messages, per network."""
    sizes = messages.groupBy(*dict.fromkeys([*per, *by])).agg(F.count(F.lit(1)).alias("_n"))
    best = F.max_by("self_name", F.struct("_n", "self_name"))
    return sizes.join(owners, list(by)).groupBy(*per).agg(best.alias("self_name"))


def message_rows(
    threads: DataFrame,
    messages: DataFrame,
    by: Sequence[str] = ("source_id",),
    person: Sequence[str] = (),
) -> DataFrame:
    """Typed message rows.

    ``threads``: thread_key, ``by`` columns, network, thread, participants, is_group.
    ``messages``: thread_key, ``by`` columns, timestamp, seq, sender, text, msg_type,
    media_kind, reaction_list, is_unsent. ``person`` separates the people in the tables.
    """
    owners = owner_names(threads, messages, by)
    # The owner names of a person: as many as exports. By export in a map, as a join on a constant
    # format name would be folded into a nested loop.
    export = F.struct(*by).alias("export")
    own = owners.groupBy(*person).agg(
        F.collect_set("self_name").alias("_own"),
        F.map_from_entries(F.collect_list(F.struct(export, "self_name"))).alias("_names"),
    )
    who = with_group_row(threads, own, person)
    others = F.array_except("participants", "_own")
    contact = F.when(F.col("is_group"), F.col("thread")).otherwise(
        F.coalesce(F.get(others, F.lit(0)), F.col("thread"))
    )
    # A thread key is unique within an export of a person.
    key = list(dict.fromkeys([*person, *by, "thread_key"]))
    heads = who.withColumns({"contact": contact, "self_name": F.element_at("_names", F.struct(*by))}).select(
        *key, "network", "thread", "is_group", "self_name", "contact"
    )
    rows = messages.join(heads, key)
    listed = F.col("reaction_list")
    rows = rows.select(
        *key,
        "network",
        "timestamp",
        F.col("timestamp").cast("date").alias("date"),
        "thread",
        "contact",
        "is_group",
        "sender",
        F.when(F.col("sender") == F.col("self_name"), F.lit("sent"))
        .otherwise(F.lit("received"))
        .alias("direction"),
        "msg_type",
        "media_kind",
        "text",
        text.utf16_length(F.col("text")).alias("char_count"),
        text.count_words(F.col("text")).alias("word_count"),
        text.count_emoji(F.col("text")).alias("emoji_count"),
        F.col("text").contains("?").alias("has_question"),
        F.size(listed).alias("reaction_count"),
        F.array_join(listed, REACTION_SEPARATOR).alias("reactions"),
        "is_unsent",
        "seq",
    )
    return conversation_columns(rows, key, [F.col("timestamp"), F.col("seq")])


def message_index(messages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dense position of every stored message, from 0, in order of time."""
    names = ["timestamp", "network", "thread", "sender", "text", "msg_id"]
    plain = [F.col(c) for c in names if c in messages.columns]
    numbered = ordered_pass(
        messages,
        keys=by,
        order=plain,
        chunk=range_chunk(messages, plain),
        running={"msg_index": F.lit(1).cast("long")},
    )
    return numbered.withColumn("msg_index", F.col("msg_index") - 1)


def first_hearing(plays: DataFrame, title: Column, by: Sequence[str] = ()) -> DataFrame:
    """Running play count per title, and whether a play is the first."""
    keyed = plays.withColumn("_title", title)
    order = [F.col("timestamp"), F.col("play_id")]
    counted = ordered_pass(
        keyed,
        keys=[*by, "_title"],
        order=order,
        chunk=range_chunk(plays, order),
        running={"play_count": F.lit(1)},
    )
    return counted.drop("_title").withColumn("is_first_play", F.col("play_count") == 1)

