"""Calendar and clock expressions over naive wall-clock timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
DAY_START_HOUR = 4  # a logical day runs from 04:00 to 04:00


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970, rounded half to even from microseconds."""
    return F.rint(epoch_micros(ts).cast("double") / 1000.0).cast("long")


def epoch_seconds(ts: Column) -> Column:
    return epoch_micros(ts).cast("double") / F.lit(1_000_000.0)


def day_epoch_ms(day: Column) -> Column:
    return F.unix_date(day).cast("long") * F.lit(DAY_MS)


def micros_to_ntz(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def weekday(ts: Column) -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return F.dayofweek(ts) - 1


def clock_hour(ts: Column) -> Column:
    """Fractional hour of the day at second precision."""
    return (
        F.hour(ts)
        + F.minute(ts) / F.lit(60.0)
        + F.floor(F.second(ts)) / F.lit(3600.0)
    )


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")


def week_start(ts: Column) -> Column:
    """Monday of the week."""
    return F.trunc(ts.cast("date"), "week")


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def logical_day(ts: Column) -> Column:
    """The day an instant belongs to when days start at 04:00."""
    return (ts - F.expr(f"INTERVAL '{DAY_START_HOUR}' HOUR")).cast("date")


def logical_day_from_ms(ms: Column) -> Column:
    return F.date_from_unix_date(
        F.floor((ms - F.lit(DAY_START_HOUR * 3_600_000)) / F.lit(DAY_MS)).cast("int")
    )


def anchor_ms(day: Column) -> Column:
    """The 04:00 instant of a logical day, in epoch milliseconds."""
    return day_epoch_ms(day) + F.lit(DAY_START_HOUR * 3_600_000)


def wall_hour(ms: Column) -> Column:
    return F.pmod(ms, F.lit(DAY_MS)).cast("double") / F.lit(3_600_000.0)


def year_fraction(day: Column) -> Column:
    """0 on 1 January, 1 on 31 December."""
    last = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))
    return (F.dayofyear(day) - 1).cast("double") / (last - 1).cast("double")


def sunday_week_of_year(day: Column) -> Column:
    """Sundays between 1 January and ``day`` (week columns that start on Sunday)."""
    jan1 = F.trunc(day, "year")
    first = F.dayofweek(jan1) - 1  # days since the last Sunday
    return F.floor((F.dayofyear(day) - 1 + first) / F.lit(7)).cast("int")


def monday_week_of_year(day: Column) -> Column:
    """Mondays since the Monday on or before 1 January."""
    jan1 = F.trunc(day, "year")
    return (F.datediff(F.trunc(day, "week"), F.trunc(jan1, "week")) / F.lit(7)).cast("int")


def parse_date_text(text: Column) -> Column:
    """ISO or day-first text as a date; null when it names no real day."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    slash = F.when(
        t.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}$"),
        F.try_to_date(F.translate(t, "/", "-"), "d-M-yyyy"),
    )
    return F.coalesce(iso, slash)
