"""Ordered passes (lead, lag, running sums, last known value) that survive hot keys.

A plain window sorts a whole key in one task; one person holding a third of all rows
would then be one task. Here a key is cut into chunks along its order column. Windows
run inside (key, chunk); a small table with one row per chunk carries first rows, last
rows and totals across the borders and is joined back on (key, chunk).

Chunks are ranges of the whole order between sampled splitters (:func:`range_chunk`), as many
as there are shuffle partitions: rows that fall into one hour, or have no time at all, spread
over tasks like any others, and the chunk table stays small. Where neighbours in time are known
to be spread out, calendar hours serve without a sample.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrail.plans.ranking import over


def hour_chunk(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(3_600_000_000)).cast("long")


def ms_hour_chunk(ms: Column) -> Column:
    return F.floor(ms / F.lit(3_600_000)).cast("long")


def sort_key(order: Sequence[Column], kinds: Sequence[str]) -> Column:
    """A string whose order in bytes is that of the columns, nulls first.

    Numbers become 16 hexadecimal digits, so they must be whole; strings end in two zero
    characters, with a zero character in them followed by a greater one.
    """
    parts = []
    for column, kind in zip(order, kinds, strict=True):
        if kind == "string":
            text = F.concat(F.replace(column, F.lit("\0"), F.lit("\0\u00ff")), F.lit("\0\0"))
        else:
            number = F.unix_micros(column.cast("timestamp")) if kind.startswith(("timestamp", "date")) else column.cast("long")
            text = F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
        parts.append(F.coalesce(F.concat(F.lit("1"), text), F.lit("0")))
    return F.concat(*parts)


def range_chunk(df: DataFrame, order: Sequence[Column], parts: int | None = None) -> Column:
    """The number of the range of ``order`` that a row falls into, for :func:`ordered_pass`.

    Splitters come from the rows with the least hashes of their place in the order, a sample of
    eight rows a range; the sample is the same on every run.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [f.dataType.simpleString() for f in df.select(*order).schema]
    key = sort_key(order, kinds)
    sample = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(8 * parts).collect()
    found = sorted({r["k"] for r in sample}, key=lambda k: k.encode())
    cuts = [found[len(found) * i // parts] for i in range(1, parts)] if found else []
    cuts = sorted(set(cuts), key=lambda k: k.encode())
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    ranges = F.lit(cuts)
    # The last splitter at or before the row, found by halving.
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, step: at + F.when(F.coalesce(F.try_element_at(ranges, at + step) <= key, F.lit(False)), step).otherwise(0),
    )


def ordered_pass(
    df: DataFrame,
    *,
    keys: Sequence[str] = (),
    order: Sequence[Column],
    chunk: Column,
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    next_: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Adds neighbour, running and carried columns over the order of each key.

    ``lag``/``lead`` give the value on the previous/next row, ``running`` an inclusive
    running sum, ``last`` the last non-null value at or before the row, ``next_`` the first
    non-null value at or after it. ``chunk`` must not decrease along ``order``; key columns
    must not be null. Ties in ``order`` make the result arbitrary, as in any window.
    """
    lag, lead, running = dict(lag or {}), dict(lead or {}), dict(running or {})
    last, next_ = dict(last or {}), dict(next_ or {})
    keys = list(keys)
    cut = [*keys, "_chunk"]
    ordinal = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])

    rows = df.withColumn("_chunk", chunk)
    local = over(cut, *order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = local.rowsBetween(Window.currentRow, Window.unboundedFollowing)

    # One row per (key, chunk).
    edges, summary = {}, []
    if lag:
        packed = F.struct(*[c.alias(n) for n, c in lag.items()])
        edges["_lag"] = F.lag(packed).over(local)
        summary.append(F.max_by(packed, ordinal).alias("_tail"))
    if lead:
        packed = F.struct(*[c.alias(n) for n, c in lead.items()])
        edges["_lead"] = F.lead(packed).over(local)
        summary.append(F.min_by(packed, ordinal).alias("_head"))
    for n, c in running.items():
        edges[f"_run_{n}"] = F.sum(c).over(upto)
        summary.append(F.sum(c).alias(f"_sum_{n}"))
    for n, c in last.items():
        edges[f"_last_{n}"] = F.last(c, ignorenulls=True).over(upto)
        summary.append(
            F.max_by(c, F.when(c.isNotNull(), ordinal)).alias(f"_end_{n}")
        )
    for n, c in next_.items():
        edges[f"_next_{n}"] = F.first(c, ignorenulls=True).over(onward)
        summary.append(
            F.min_by(c, F.when(c.isNotNull(), ordinal)).alias(f"_start_{n}")
        )

    chunks = rows.groupBy(*cut).agg(*summary)
    across = over(keys, F.col("_chunk"))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = across.rowsBetween(1, Window.unboundedFollowing)
    carried = []
    if lag:
        carried.append(F.lag("_tail").over(across).alias("_from_tail"))
    if lead:
        carried.append(F.lead("_head").over(across).alias("_from_head"))
    for n in running:
        carried.append(F.sum(f"_sum_{n}").over(earlier).alias(f"_base_{n}"))
    for n in last:
        carried.append(F.last(f"_end_{n}", ignorenulls=True).over(earlier).alias(f"_past_{n}"))
    for n in next_:
        carried.append(F.first(f"_start_{n}", ignorenulls=True).over(later).alias(f"_ahead_{n}"))
    chunks = chunks.select(*cut, *carried)

    out = rows.withColumns(edges).join(chunks, cut, "left")
    final = {}
    for n in lag:
        final[n] = F.coalesce(F.col("_lag"), F.col("_from_tail"))[n]
    for n in lead:
        final[n] = F.coalesce(F.col("_lead"), F.col("_from_head"))[n]
    for n in running:
        final[n] = F.coalesce(F.col(f"_run_{n}"), F.lit(0)) + F.coalesce(F.col(f"_base_{n}"), F.lit(0))
    for n in last:
        final[n] = F.coalesce(F.col(f"_last_{n}"), F.col(f"_past_{n}"))
    for n in next_:
        final[n] = F.coalesce(F.col(f"_next_{n}"), F.col(f"_ahead_{n}"))
    kept = [F.col(c) for c in df.columns if c not in final]
    return out.select(*kept, *[c.alias(n) for n, c in final.items()])
