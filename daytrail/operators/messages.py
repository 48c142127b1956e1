"""Questions about stored messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrail.functions import dates, labels
from daytrail.functions.numbers import count_where, half_up, ratio, sum_where
from daytrail.plans.filters import require
from daytrail.plans.ranking import over, quantiles_of_counts, small, top_k, with_group_row
from daytrail.plans.sketches import sketched_count, sketched_quantiles
from daytrail.session import cut_lineage


def sent() -> Column:
    return F.col("direction") == "sent"


def received() -> Column:
    return F.col("direction") == "received"


def is_reply() -> Column:
    """A reply counts only inside a session: openers answer nothing."""
    return F.col("reply_delay_seconds").isNotNull() & ~F.col("is_session_start")


def network_summary(messages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What is stored per service."""
    return messages.groupBy(*by, "network").agg(
        F.countDistinct("thread").alias("threads"),
        F.count(F.lit(1)).alias("messages"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
    )


def _reply_counts(messages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Messages by reply delay (null where it is no reply) and who replied; written once, read often."""
    counts = messages.groupBy(*keys, F.when(is_reply(), F.col("reply_delay_seconds").cast("double")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_all"),
        count_where(is_reply() & sent()).alias("_n_my_median_seconds"),
        count_where(is_reply() & received()).alias("_n_their_median_seconds"),
    )
    return cut_lineage(counts)


def _reply_medians(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    wanted = {"my_median_seconds": 0.5, "their_median_seconds": 0.5}
    return quantiles_of_counts(counts.filter(F.col("_v").isNotNull()).drop("_all"), wanted, by=keys)


def message_macro_stats(messages: DataFrame, by: Sequence[str] = (), sketched: bool = False) -> DataFrame:
    """Sixteen headline figures. A reaction on a message I sent is one I received.

    ``sketched`` takes distinct counts and medians from sketches, within their error.
    """
    many = sketched_count if sketched else F.countDistinct
    # First per contact, session and day: the distinct counts then expand few rows.
    ones = messages.groupBy(*by, "contact", "session_id", "date").agg(
        F.count(F.lit(1)).alias("all"),
        count_where(sent()).alias("sent"),
        count_where(received()).alias("received"),
        F.sum("word_count").alias("words"),
        F.sum("char_count").alias("chars"),
        count_where(F.col("media_kind") != "none").alias("media"),
        count_where(F.col("media_kind") == "voice").alias("voice"),
        sum_where(F.col("reaction_count"), sent()).alias("got"),
        sum_where(F.col("reaction_count"), received()).alias("gave"),
    )
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    counts = ones.groupBy(*by).agg(
        total("all", "total_messages"),
        total("sent", "sent_messages"),
        total("received", "received_messages"),
        many(F.col("contact")).alias("contacts"),
        many(F.when(F.col("date").isNotNull(), F.xxhash64("date")) if sketched else F.col("date")).alias("active_days"),
        # As in the exact count, sessions without a contact do not count.
        many(F.when(F.col("contact").isNotNull() & F.col("session_id").isNotNull(), F.xxhash64("contact", "session_id")))
        .alias("conversations") if sketched else F.countDistinct("contact", "session_id").alias("conversations"),
        total("words", "words"),
        total("chars", "characters"),
        total("media", "media_messages"),
        total("voice", "voice_notes"),
        total("got", "reactions_received"),
        total("gave", "reactions_given"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
    )
    if sketched:
        sides = {"my_median_seconds": (0.5, is_reply() & sent()), "their_median_seconds": (0.5, is_reply() & received())}
        medians = sketched_quantiles(messages, F.col("reply_delay_seconds"), sides, by=by)
    else:
        medians = _reply_medians(_reply_counts(messages, by), by)
    return with_group_row(counts, medians, by, "left")


def monthly_by_contact(messages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (
        require(messages, "timestamp")
        .groupBy(
            *by,
            dates.month_start(F.col("timestamp")).alias("month"),
            F.coalesce("contact", F.lit(labels.UNKNOWN)).alias("name"),
        )
        .agg(F.count(F.lit(1)).alias("messages"))
    )


def hour_weekday_grid(messages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Messages per weekday (0 = Sunday), hour and direction."""
    return (
        require(messages, "timestamp")
        .groupBy(
            *by,
            dates.weekday(F.col("timestamp")).alias("dow"),
            F.hour("timestamp").alias("hour"),
            "direction",
        )
        .agg(F.count(F.lit(1)).alias("messages"))
    )


def both_directions(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return grid.groupBy(*by, "dow", "hour").agg(F.sum("messages").alias("messages"))


def daily_counts(messages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (
        require(messages, "date")
        .groupBy(*by, "date")
        .agg(
            F.count(F.lit(1)).alias("messages"),
            count_where(sent()).alias("sent"),
            count_where(received()).alias("received"),
            F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"),
            F.countDistinct("contact").alias("contacts"),
        )
    )


def contact_balance(messages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Who carries each conversation: volume, double texts and session openings per side."""
    double, opens = F.col("is_double_text"), F.col("is_session_start")
    return messages.groupBy(*by, "contact").agg(
        F.count(F.lit(1)).alias("messages"),
        count_where(sent()).alias("sent"),
        count_where(received()).alias("received"),
        count_where(double & sent()).alias("my_double_texts"),
        count_where(double & received()).alias("their_double_texts"),
        count_where(opens).alias("sessions"),
        count_where(opens & sent()).alias("sessions_i_started"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
    )


def reply_times(messages: DataFrame, min_replies: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Median reply delay per side, for contacts with enough replies on both."""
    least = max(1, int(min_replies))
    keys = [*by, "contact"]
    counted = _reply_counts(messages, keys)
    counts = (
        counted.groupBy(*keys)
        .agg(
            F.sum("_all").alias("messages"),
            F.sum("_n_my_median_seconds").alias("my_replies"),
            F.sum("_n_their_median_seconds").alias("their_replies"),
        )
        .filter((F.col("my_replies") >= least) & (F.col("their_replies") >= least))
    )
    return counts.join(_reply_medians(counted, keys), keys)


def top_contact_months(messages: DataFrame, top: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """Monthly volume of the busiest contacts, zero-filled over the whole span.

    Counts per contact and month feed everything: leaders, span and grid.
    """
    monthly = messages.groupBy(
        *by, "contact", dates.month_start(F.col("timestamp")).alias("month")
    ).agg(F.count(F.lit(1)).alias("messages"))
    totals = monthly.groupBy(*by, "contact").agg(F.sum("messages").alias("_n"))
    leaders = top_k(totals, top, F.desc("_n"), F.asc("contact"), by=by).select(*by, "contact")
    span = monthly.groupBy(*by).agg(F.min("month").alias("_a"), F.max("month").alias("_b"))
    named = with_group_row(leaders, span, by)
    grid = named.select(
        *by, "contact", F.explode(F.sequence("_a", "_b", F.expr("INTERVAL '1' MONTH"))).alias("month")
    )
    # The grid is leaders x months; the counts are matched to it, not the other way round.
    filled = grid.join(monthly, [*by, "contact", "month"], "left")
    return filled.select(
        *by,
        "month",
        F.col("contact").alias("name"),
        F.coalesce("messages", F.lit(0)).alias("messages"),
    )


def reaction_breakdown(
    messages: DataFrame, separator: str = ",", by: Sequence[str] = ()
) -> DataFrame:
    """Reactions per emoji, received (on what I sent) and given."""
    parts = F.split("reactions", r"\Q" + separator + r"\E")
    return (
        messages.filter(F.col("reactions").isNotNull() & (F.col("reactions") != ""))
        .select(*by, "direction", F.explode(parts).alias("emoji"))
        .filter(F.col("emoji") != "")
        .groupBy(*by, "emoji")
        .agg(count_where(sent()).alias("received"), count_where(received()).alias("given"))
    )


def reaction_rates(messages: DataFrame, min_messages: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Reactions received per 100 messages sent, per contact."""
    return (
        messages.filter(sent())
        .groupBy(*by, "contact")
        .agg(
            F.count(F.lit(1)).alias("messages_sent"),
            F.coalesce(F.sum("reaction_count"), F.lit(0)).alias("reactions_received"),
        )
        .filter(F.col("messages_sent") >= max(1, int(min_messages)))
        .withColumn("rate_per_100", ratio(F.col("reactions_received"), F.col("messages_sent")) * 100)
    )


def top_reactor(rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return top_k(rates, 1, F.desc("rate_per_100"), F.asc("contact"), by=by)


def double_text_total(balance: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return balance.groupBy(*by).agg(F.sum("my_double_texts").alias("my_double_texts"))


def top_reactions(breakdown: DataFrame, top: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The commonest emojis as one row per side, empty sides dropped."""
    total = F.col("received") + F.col("given")
    best = top_k(breakdown, top, F.desc(total), F.asc("emoji"), by=by)
    return (
        best.unpivot([*by, "emoji"], ["received", "given"], "side", "count")
        .withColumn("side", F.initcap("side"))
        .filter(F.col("count") > 0)
    )


def message_time_domain(messages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Midnight of the first and of the last day, in epoch milliseconds."""
    return require(messages, "timestamp").groupBy(*by).agg(
        dates.day_epoch_ms(F.to_date(F.min("timestamp"))).alias("min_ms"),
        dates.day_epoch_ms(F.to_date(F.max("timestamp"))).alias("max_ms"),
    )


def half_of_volume(balance: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The fewest contacts that carry half of all messages.

    Contacts are first counted by their volume. The running total walks over distinct
    volumes, of which there are few, not over contacts.
    """
    levels = balance.groupBy(*by, F.col("messages").alias("volume")).agg(
        F.count(F.lit(1)).alias("n")
    )
    w = over(by, F.desc("volume")).rowsBetween(Window.unboundedPreceding, 0)
    everything = over(by)
    mass = F.col("volume") * F.col("n")
    running = levels.select(
        *by,
        "volume",
        "n",
        F.sum(mass).over(w).alias("mass"),
        F.sum("n").over(w).alias("people"),
        F.sum(mass).over(everything).alias("total"),
    )
    # Inside the level that crosses half, each contact adds ``volume``.
    before = F.col("mass") - F.col("volume") * F.col("n")
    needed = F.ceil((F.col("total") / 2 - before) / F.col("volume"))
    place = F.col("people") - F.col("n") + F.greatest(needed, F.lit(1))
    return (
        running.filter(F.col("mass") * 2 >= F.col("total"))
        .groupBy(*by)
        .agg(F.min(place).cast("long").alias("contacts"))
    )


def sent_share(balance: DataFrame, top: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """The busiest contacts with the share of messages I sent, and their place by that share."""
    busy = top_k(
        balance.filter(F.col("messages") > 0), top, F.desc("messages"), F.asc("contact"), by=by
    )
    share = ratio(F.col("sent"), F.col("messages"))
    place = F.row_number().over(over(by, F.desc("share"), F.desc("messages"), F.asc("contact")))
    return busy.select(*by, "contact", "messages", "sent", "received", share.alias("share")).withColumn(
        "place", place  # of at most ``top`` rows
    )


def reply_quadrant(replies: DataFrame, labelled: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Both medians floored at one second, the busiest contacts marked."""
    rows = replies.filter(
        F.col("my_median_seconds").isNotNull() & F.col("their_median_seconds").isNotNull()
    ).select(
        *by,
        "contact",
        F.greatest(F.lit(1.0), "my_median_seconds").alias("mine"),
        F.greatest(F.lit(1.0), "their_median_seconds").alias("theirs"),
        "messages",
    )
    marked = top_k(rows, labelled, F.desc("messages"), F.asc("contact"), by=by).select(
        *by, "contact", F.lit(True).alias("labelled")
    )
    joined = rows.join(marked if by else small(marked, labelled), [*by, "contact"], "left")
    return joined.withColumn("labelled", F.coalesce("labelled", F.lit(False)))


def explorer_message_points(messages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Message points with every explorer dimension as display text."""
    ts = F.col("timestamp")
    return require(messages, "timestamp").select(
        *by,
        "msg_id",
        dates.day_epoch_ms(F.to_date(ts)).alias("x"),
        dates.clock_hour(ts).alias("y"),
        ts.alias("sent_at"),
        "sender",
        labels.network_label(F.col("network")).alias("f_network"),
        F.coalesce("contact", F.lit(labels.UNKNOWN)).alias("f_contact"),
        F.when(sent(), F.lit("Sent")).otherwise(F.lit("Received")).alias("f_direction"),
        labels.filled(F.col("msg_type"), "text").alias("f_type"),
        labels.filled(F.col("media_kind"), "none").alias("f_media_kind"),
        F.when(F.col("reaction_count") > 0, F.lit("Reacted"))
        .otherwise(F.lit("No reaction"))
        .alias("f_reacted"),
        labels.length_bucket(F.col("char_count")).alias("f_length"),
        dates.weekday(ts).cast("string").alias("dow"),
        F.year(ts).cast("string").alias("year"),
        F.coalesce("word_count", F.lit(0)).alias("words"),
        F.coalesce("char_count", F.lit(0)).alias("chars"),
        "text",
        "reactions",
    )


def share_percent(part: Column, total: Column) -> Column:
    return half_up(ratio(part, total) * 100.0).cast("int")
