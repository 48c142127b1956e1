"""Message queries and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from daytrail.catalog.registry import messages_query, register, talk_query
from daytrail.operators import conversation, messages, sequence, sessions
from daytrail.plans import adapters
from daytrail.session import cut_lineage, new_folder

OWNER = ["owner"]
REPLY = "reply_delay_seconds IS NOT NULL AND NOT is_session_start"

messages_query(
    "network_summary",
    """SELECT network, COUNT(DISTINCT thread) AS threads, COUNT(*) AS messages,
         MIN(date) AS first_day, MAX(date) AS last_day FROM messages GROUP BY network""",
    messages.network_summary,
)
talk_query(
    "conversation_columns",
    """SELECT msg_id, thread, ROUND(gap_seconds, 3) AS gap_seconds,
         ROUND(reply_delay_seconds, 3) AS reply_delay_seconds, is_double_text, is_session_start, session_id
       FROM talk""",
    lambda m: m.select(
        "msg_id",
        "thread",
        F.round("gap_seconds", 3).alias("gap_seconds"),
        F.round("reply_delay_seconds", 3).alias("reply_delay_seconds"),
        "is_double_text",
        "is_session_start",
        "session_id",
    ),
)
talk_query(
    "session_openers_excluded",
    f"""SELECT direction, COUNT(*) AS replies, ROUND(MAX(reply_delay_seconds), 3) AS slowest
        FROM talk WHERE {REPLY} GROUP BY 1""",
    lambda m: m.filter(messages.is_reply())
    .groupBy("direction")
    .agg(
        F.count(F.lit(1)).alias("replies"),
        F.round(F.max("reply_delay_seconds"), 3).alias("slowest"),
    ),
)
talk_query(
    "message_macro_stats",
    f"""SELECT COUNT(*) AS total_messages, SUM((direction = 'sent')::INT)::BIGINT AS sent_messages,
          SUM((direction = 'received')::INT)::BIGINT AS received_messages,
          COUNT(DISTINCT contact) AS contacts, COUNT(DISTINCT date) AS active_days,
          COUNT(DISTINCT (contact, session_id)) AS conversations,
          SUM(word_count)::BIGINT AS words, SUM(char_count)::BIGINT AS characters,
          SUM((media_kind <> 'none')::INT)::BIGINT AS media_messages,
          SUM((media_kind = 'voice')::INT)::BIGINT AS voice_notes,
          SUM(CASE direction WHEN 'sent' THEN reaction_count ELSE 0 END)::BIGINT AS reactions_received,
          SUM(CASE direction WHEN 'received' THEN reaction_count ELSE 0 END)::BIGINT AS reactions_given,
          MIN(date) AS first_day, MAX(date) AS last_day,
          ROUND(MEDIAN(reply_delay_seconds) FILTER (WHERE direction = 'sent' AND {REPLY}), 7) AS my_median_seconds,
          ROUND(MEDIAN(reply_delay_seconds) FILTER (WHERE direction = 'received' AND {REPLY}), 7) AS their_median_seconds
        FROM talk""",
    lambda m: messages.message_macro_stats(m).withColumns(
        {c: F.round(c, 7) for c in ("my_median_seconds", "their_median_seconds")}
    ),
    stored=True,
)
MONTHLY = """SELECT CAST(date_trunc('month', timestamp) AS DATE) AS month, contact AS name,
               COUNT(*) AS messages FROM messages GROUP BY 1, 2"""
messages_query("monthly_by_contact", MONTHLY, messages.monthly_by_contact)
GRID = """SELECT CAST(dayofweek(timestamp) AS INTEGER) AS dow, CAST(hour(timestamp) AS INTEGER) AS hour,
            direction, COUNT(*) AS messages FROM messages GROUP BY 1, 2, 3"""
messages_query("hour_weekday_grid", GRID, messages.hour_weekday_grid)
messages_query(
    "hour_weekday_both",
    f"SELECT dow, hour, SUM(messages)::BIGINT AS messages FROM ({GRID}) GROUP BY 1, 2",
    lambda m: messages.both_directions(messages.hour_weekday_grid(m)),
)
messages_query(
    "daily_message_counts",
    """SELECT date, COUNT(*) AS messages, SUM((direction = 'sent')::INT)::BIGINT AS sent,
         SUM((direction = 'received')::INT)::BIGINT AS received, SUM(word_count)::BIGINT AS words,
         COUNT(DISTINCT contact) AS contacts FROM messages GROUP BY date""",
    messages.daily_counts,
)
BALANCE = """
  SELECT contact, COUNT(*) AS messages, SUM((direction = 'sent')::INT)::BIGINT AS sent,
    SUM((direction = 'received')::INT)::BIGINT AS received,
    SUM((is_double_text AND direction = 'sent')::INT)::BIGINT AS my_double_texts,
    SUM((is_double_text AND direction = 'received')::INT)::BIGINT AS their_double_texts,
    SUM(is_session_start::INT)::BIGINT AS sessions,
    SUM((is_session_start AND direction = 'sent')::INT)::BIGINT AS sessions_i_started,
    MIN(date) AS first_day, MAX(date) AS last_day FROM talk GROUP BY contact"""
talk_query("contact_balance", BALANCE, messages.contact_balance)
REPLIES = f"""
  SELECT contact, COUNT(*) AS messages,
    COUNT(*) FILTER (WHERE direction = 'sent' AND {REPLY}) AS my_replies,
    COUNT(*) FILTER (WHERE direction = 'received' AND {REPLY}) AS their_replies,
    ROUND(MEDIAN(reply_delay_seconds) FILTER (WHERE direction = 'sent' AND {REPLY}), 7) AS my_median_seconds,
    ROUND(MEDIAN(reply_delay_seconds) FILTER (WHERE direction = 'received' AND {REPLY}), 7) AS their_median_seconds
  FROM talk GROUP BY contact HAVING my_replies >= {{0}} AND their_replies >= {{0}}"""


def rounded_replies(m, least):
    return messages.reply_times(m, least).withColumns(
        {c: F.round(c, 7) for c in ("my_median_seconds", "their_median_seconds")}
    )


talk_query("reply_times", REPLIES.format(5), lambda m: rounded_replies(m, 5), stored=True)
talk_query(
    "reply_quadrant",
    f"""SELECT contact, GREATEST(1.0, my_median_seconds) AS mine, GREATEST(1.0, their_median_seconds) AS theirs,
          messages, ROW_NUMBER() OVER (ORDER BY messages DESC, contact) <= 12 AS labelled
        FROM ({REPLIES.format(1)})""",
    lambda m: messages.reply_quadrant(cut_lineage(rounded_replies(m, 1))),
    stored=True,
)
# The messages lie in one month; a day standing in for a month exercises the zero-filled grid.
SPREAD = """(SELECT * REPLACE (CAST(DATE '2020-01-01' + to_months(CAST(2 * date_diff('day', DATE '2024-01-01', date) AS INTEGER))
             AS TIMESTAMP) AS timestamp) FROM messages)"""


def spread_months(m):
    """Moves each day to every second month, which leaves months to be filled with zeros."""
    day = F.datediff("date", F.lit("2024-01-01").cast("date"))
    moved = F.add_months(F.lit("2020-01-01").cast("date"), day * 2)
    return m.withColumn("timestamp", moved.cast("timestamp_ntz"))


messages_query(
    "top_contact_months",
    f"""WITH many AS {SPREAD},
        t AS (SELECT contact FROM many GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 15),
        s AS (SELECT MIN(timestamp) AS a, MAX(timestamp) AS b FROM many),
        m AS (SELECT unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS month FROM s)
        SELECT CAST(m.month AS DATE) AS month, t.contact AS name, COUNT(q.msg_id) AS messages
        FROM m CROSS JOIN t LEFT JOIN many q ON q.contact = t.contact AND q.timestamp = m.month
        GROUP BY 1, 2""",
    lambda m: messages.top_contact_months(spread_months(m)),
)
REACTIONS = """
  SELECT emoji, SUM((direction = 'sent')::INT)::BIGINT AS received,
    SUM((direction = 'received')::INT)::BIGINT AS given
  FROM (SELECT direction, unnest(string_split(reactions, ',')) AS emoji FROM messages)
  WHERE emoji <> '' GROUP BY 1"""
messages_query("reaction_breakdown", REACTIONS, messages.reaction_breakdown)
messages_query(
    "top_reactions",
    f"""WITH b AS (SELECT * FROM ({REACTIONS}) ORDER BY received + given DESC, emoji LIMIT 1)
        SELECT emoji, 'Received' AS side, received AS count FROM b WHERE received > 0
        UNION ALL SELECT emoji, 'Given', given FROM b WHERE given > 0""",
    lambda m: messages.top_reactions(messages.reaction_breakdown(m), 1),
)
RATES = """
  SELECT contact, COUNT(*) AS messages_sent, SUM(reaction_count)::BIGINT AS reactions_received,
    SUM(reaction_count)::DOUBLE / COUNT(*)::DOUBLE * 100 AS rate_per_100
  FROM messages WHERE direction = 'sent' GROUP BY 1 HAVING COUNT(*) >= 20"""
messages_query("reaction_rates", RATES, messages.reaction_rates)
messages_query(
    "top_reactor",
    f"SELECT * FROM ({RATES}) ORDER BY rate_per_100 DESC, contact LIMIT 1",
    lambda m: messages.top_reactor(messages.reaction_rates(m)),
)
talk_query(
    "double_text_total",
    "SELECT COUNT(*) AS my_double_texts FROM talk WHERE is_double_text AND direction = 'sent'",
    lambda m: messages.double_text_total(messages.contact_balance(m)),
)
messages_query(
    "message_time_domain",
    """SELECT epoch_ms(CAST(MIN(timestamp) AS DATE)::TIMESTAMP) AS min_ms,
         epoch_ms(CAST(MAX(timestamp) AS DATE)::TIMESTAMP) AS max_ms FROM messages""",
    messages.message_time_domain,
)
talk_query(
    "half_of_volume",
    """WITH c AS (SELECT contact, COUNT(*) AS n FROM talk GROUP BY 1),
       r AS (SELECT ROW_NUMBER() OVER w AS k, SUM(n) OVER w AS running, SUM(n) OVER () AS total
             FROM c WINDOW w AS (ORDER BY n DESC, contact ROWS UNBOUNDED PRECEDING))
       SELECT MIN(k) AS contacts FROM r WHERE running * 2 >= total""",
    lambda m: messages.half_of_volume(messages.contact_balance(m)),
)
talk_query(
    "sent_share",
    f"""SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY share DESC, messages DESC, contact) AS INTEGER) AS place
        FROM (SELECT contact, messages, sent, received, sent::DOUBLE / messages::DOUBLE AS share
              FROM ({BALANCE}) ORDER BY messages DESC, contact LIMIT 20)""",
    lambda m: messages.sent_share(messages.contact_balance(m)),
)
messages_query(
    "message_index",
    """SELECT msg_id, ROW_NUMBER() OVER (ORDER BY timestamp, network, thread, sender, text, msg_id) - 1 AS msg_index
       FROM messages""",
    lambda m: conversation.message_index(m).select("msg_id", "msg_index"),
)
messages_query(
    "longest_message_streak",
    """WITH d AS (SELECT DISTINCT date FROM messages),
       i AS (SELECT date, date - CAST(ROW_NUMBER() OVER (ORDER BY date) AS INTEGER) AS g FROM d)
       SELECT COUNT(*) AS length, MIN(date) AS start, MAX(date) AS "end" FROM i GROUP BY g
       ORDER BY length DESC, start LIMIT 1""",
    lambda m: sequence.longest_streak(m),
)


@register(
    "sessions_kept_up",
    """SELECT msg_id, thread, ROUND(gap_seconds, 3) AS gap_seconds, ROUND(reply_delay_seconds, 3) AS reply_delay_seconds,
         is_double_text, is_session_start, session_id FROM talk""",
    "talk",
)
def sessions_kept_up(spark, sf_dir):
    """Stored sessions after two lots of late messages, one of them sent twice."""
    every, path = adapters.messages(spark, sf_dir), new_folder(spark)
    lot = lambda *rest: every.filter((F.col("msg_id") % 10).isin(*rest))
    sessions.store_sessions(lot(0, 1, 2, 3, 4, 5), path)
    for late in (lot(6, 7), lot(7, 8, 9)):
        sessions.add_late_messages(spark, path, late)
    got = sessions.stored_sessions(spark, path)
    return got.select(
        "msg_id", "thread", F.round("gap_seconds", 3).alias("gap_seconds"),
        F.round("reply_delay_seconds", 3).alias("reply_delay_seconds"),
        "is_double_text", "is_session_start", "session_id",
    )
