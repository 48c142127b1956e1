"""Text repair and text metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension families and character classes.
MEDIA_EXTENSIONS = {
    "photo": ("jpg", "jpeg", "png", "webp", "heic"),
    "video": ("mp4", "mov", "mkv", "3gp"),
    "voice": ("ogg", "opus", "m4a", "mp3", "aac"),
    "gif": ("gif",),
}
MANGLED_UTF8 = r"[\x{C2}-\x{F4}][\x{80}-\x{BF}]"
BEYOND_LATIN1 = r"[^\x{00}-\x{FF}]"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
# Pictographic code points (Unicode emoji data, Extended_Pictographic), as ranges the
# JVM's regular expressions accept.
PICTOGRAPHIC = (
    r"[\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}-\x{21AA}"
    r"\x{231A}-\x{231B}\x{2328}\x{2388}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}"
    r"\x{25AA}-\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2605}\x{2607}-\x{2612}"
    r"\x{2614}-\x{2685}\x{2690}-\x{2705}\x{2708}-\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}"
    r"\x{2728}\x{2733}-\x{2734}\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}"
    r"\x{2763}-\x{2767}\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}\x{2934}-\x{2935}"
    r"\x{2B05}-\x{2B07}\x{2B1B}-\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}"
    r"\x{1F000}-\x{1F0FF}\x{1F10D}-\x{1F10F}\x{1F12F}\x{1F16C}-\x{1F171}\x{1F17E}-\x{1F17F}"
    r"\x{1F18E}\x{1F191}-\x{1F19A}\x{1F1AD}-\x{1F1E5}\x{1F201}-\x{1F20F}\x{1F21A}\x{1F22F}"
    r"\x{1F232}-\x{1F23A}\x{1F23C}-\x{1F23F}\x{1F249}-\x{1F3FA}\x{1F400}-\x{1F53D}"
    r"\x{1F546}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F774}-\x{1F77F}\x{1F7D5}-\x{1F7FF}"
    r"\x{1F80C}-\x{1F80F}\x{1F848}-\x{1F84F}\x{1F85A}-\x{1F85F}\x{1F888}-\x{1F88F}"
    r"\x{1F8AE}-\x{1F8FF}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1FAFF}"
    r"\x{1FC00}-\x{1FFFD}]"
)
# Few ranges that hold all of these.
PICTOGRAPHIC_HULL = r"\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F000}-\x{1FFFD}"


def fix_mojibake(text: Column) -> Column:
    """Repairs UTF-8 that was read as Latin-1; anything else passes unchanged."""
    raw = F.encode(text, "ISO-8859-1")
    suspicious = text.rlike(MANGLED_UTF8) & ~text.rlike(BEYOND_LATIN1)
    return F.when(
        F.coalesce(suspicious, F.lit(False)),
        F.coalesce(F.try_validate_utf8(raw.cast("string")), text),
    ).otherwise(text)


def media_kind(uri: Column) -> Column:
    ext = F.lower(F.regexp_extract(uri, r"(?i)\.([a-z0-9]+)(?:\?|$)", 1))
    expr = F.when(F.lit(False), F.lit(""))
    for kind, extensions in MEDIA_EXTENSIONS.items():
        expr = expr.when(ext.isin(*extensions), F.lit(kind))
    return expr.otherwise(F.lit("other"))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.char_length(text) + F.regexp_count(text, F.lit(ASTRAL))


def count_words(text: Column) -> Column:
    # Plain characters are told by the first range, before all kinds of space are tried.
    space = r"\s\x{A0}\x{FEFF}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}"
    return F.regexp_count(text, F.lit(rf"[\x{{21}}-\x{{7E}}[^{space}]]+"))


def count_emoji(text: Column) -> Column:
    # Most characters lie outside the hull and need not be tried against every range.
    return F.regexp_count(text, F.lit(f"[{PICTOGRAPHIC_HULL}&&{PICTOGRAPHIC}]"))
