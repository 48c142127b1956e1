"""Fixed label tables and bucket expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels, thresholds and codes users see in reports.
INTENTIONAL_START = ("clickrow", "playbtn", "fwdbtn", "backbtn")
INTENTIONAL_STOP = ("fwdbtn", "backbtn", "endplay")
EVENING_FROM_HOUR = 19
EVENING_TO_HOUR = 5
NETWORK_LABELS = {"messenger": "Messenger", "instagram": "Instagram", "whatsapp": "WhatsApp"}
LENGTH_LIMITS = ((10, "≤10"), (40, "11–40"), (120, "41–120"))
LENGTH_OVERFLOW = "120+"
SPEED_LIMITS = (
    (1, "0"), (5, "1–5"), (15, "5–15"), (30, "15–30"),
    (50, "30–50"), (90, "50–90"), (130, "90–130"),
)
SPEED_OVERFLOW = "130+"
SPEED_GLITCH_KMH = 400
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
MEDIA_LABELS = {"track": "Music", "podcast": "Podcast"}
UNKNOWN = "Unknown"


def filled(col: Column, default: str = UNKNOWN) -> Column:
    """Trimmed text, or ``default`` when null or blank."""
    return F.coalesce(F.nullif(F.trim(col.cast("string")), F.lit("")), F.lit(default))


def true_false(col: Column) -> Column:
    return F.when(col, F.lit("True")).otherwise(F.lit("False"))


def lookup(col: Column, table: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(col, F.lit(""))), default)


def network_label(col: Column) -> Column:
    return lookup(col, NETWORK_LABELS, F.lit(UNKNOWN))


def _ladder(x: Column, limits, overflow: str, *, inclusive: bool) -> Column:
    expr = None
    for bound, label in limits:
        cond = x <= bound if inclusive else x < bound
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(overflow))


def length_bucket(chars: Column) -> Column:
    return _ladder(chars, LENGTH_LIMITS, LENGTH_OVERFLOW, inclusive=True)


def speed_bucket(kmh: Column) -> Column:
    return F.when(kmh.isNull() | (kmh > SPEED_GLITCH_KMH), F.lit(UNKNOWN)).otherwise(
        _ladder(kmh, SPEED_LIMITS, SPEED_OVERFLOW, inclusive=False)
    )


def azimuth_bucket(deg: Column) -> Column:
    """Eight compass points, each 45 degrees wide and centred on its direction."""
    index = F.pmod(F.floor((deg + 22.5) / 45.0), F.lit(8)).cast("int")
    names = F.array(*[F.lit(c) for c in COMPASS])
    return F.when(deg.isNull(), F.lit(UNKNOWN)).otherwise(F.element_at(names, index + 1))


def weekday_name(dow: Column) -> Column:
    """Name for 0..7, where both 0 and 7 are Sunday."""
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.pmod(dow, F.lit(7)) + 1)


def weekday_order(dow: Column) -> Column:
    """Monday-first position 0..6."""
    return F.pmod(dow + 6, F.lit(7))


def media_label(col: Column) -> Column:
    return lookup(col, MEDIA_LABELS, col)


def is_evening(hour: Column) -> Column:
    return (hour >= EVENING_FROM_HOUR) | (hour <= EVENING_TO_HOUR)
