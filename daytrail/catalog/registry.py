"""Registration of queries over the test tables, and SQL text shared by the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from daytrail.plans import adapters
from daytrail.session import cut_lineage, prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Views by name. Each may use the ones before it.
VIEWS = {
    "plays": adapters.plays_sql(),
    "messages": adapters.messages_sql(),
    "segments": adapters.segments_sql(),
    # Conversation columns: neighbours per thread, then a running count of session starts.
    "talk": """
      SELECT *, CAST(SUM(CASE WHEN is_session_start THEN 1 ELSE 0 END)
                     OVER (PARTITION BY thread ORDER BY timestamp, msg_id) AS BIGINT) AS session_id
      FROM (SELECT * EXCLUDE (pus, ps), us_gap AS gap_seconds,
              CASE WHEN sender <> ps THEN us_gap END AS reply_delay_seconds,
              COALESCE(sender = ps AND us_gap > 300, FALSE) AS is_double_text,
              pus IS NULL OR us_gap > 21600 AS is_session_start
            FROM (SELECT *, (epoch_us(timestamp) - pus) / 1000000.0 AS us_gap
                  FROM (SELECT *, LAG(epoch_us(timestamp)) OVER w AS pus, LAG(sender) OVER w AS ps
                        FROM messages WINDOW w AS (PARTITION BY thread ORDER BY timestamp, msg_id))))""",
}
NEEDS = {"talk": ["messages"]}


def with_views(body: str, *views: str) -> str:
    """``body`` preceded by the named views as CTEs (skipping names it does not use)."""
    wanted: list[str] = []
    for view in views:
        for name in (*NEEDS.get(view, ()), view):
            if name not in wanted:
                wanted.append(name)
    ctes = ", ".join(f"{name} AS ({VIEWS[name]})" for name in wanted)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def register(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Adds a query, with its check when SQL can express it."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, *views) if views else sql.strip()
        return fn

    return add


def plays_query(name: str, sql: str | None, make: Callable[[DataFrame], DataFrame]) -> None:
    register(name, sql, "plays")(lambda spark, d: make(adapters.plays(spark, d)))


def messages_query(name: str, sql: str | None, make: Callable[[DataFrame], DataFrame]) -> None:
    register(name, sql, "messages")(lambda spark, d: make(adapters.messages(spark, d)))


def talk_query(name: str, sql: str | None, make: Callable[[DataFrame], DataFrame], stored: bool = False) -> None:
    """Over messages with their conversation columns, which are a stored table where much is asked."""
    from daytrail.operators.conversation import conversation_columns

    keep = cut_lineage if stored else lambda talk: talk
    register(name, sql, "talk")(
        lambda spark, d: make(keep(conversation_columns(adapters.messages(spark, d))))
    )


def segments_query(name: str, sql: str | None, make: Callable[[DataFrame], DataFrame]) -> None:
    register(name, sql, "segments")(lambda spark, d: make(adapters.segments(spark, d)))
