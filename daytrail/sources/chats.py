"""Chat exports: recognising files, reading three formats, appending to the message table.

Every format ends in the same pair of tables. ``threads``: source_id, thread_key, network,
thread, participants, is_group. ``messages``: source_id, thread_key, timestamp, seq, sender,
text, msg_type, media_kind, reaction_list, is_unsent.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daytrail.functions import text as words
from daytrail.operators.conversation import message_index
from daytrail.plans.ranking import over, top_k, with_group_row
from daytrail.sources import batches
from daytrail.sources.files import raw_fields, raw_items, read_contents, read_lines, with_owner

# Formats, markers, layouts and field names of the exports.
META, NORMALIZED, CHAT_TEXT = "meta-json", "normalized-json", "whatsapp-text"
ARCHIVE_LAYOUT = (
    r"(?i)messages/(inbox|e2ee_cutover|archived_threads|filtered_threads|message_requests)"
    r"/[^/]+/message_\d+\.json$"
)
INSTAGRAM_MARKS = ("your_instagram_activity", "/instagram/")
MESSENGER_MARKS = ("your_facebook_activity", "/facebook/", "facebook-")
GROUP_THREAD_TYPES = ("RegularGroup", "GroupThread")
ATTACHMENTS = (
    ("audio_files", "voice"), ("videos", "video"), ("photos", "photo"), ("gifs", "gif"), ("files", "other"),
)
META_DDL = (
    "participants array<struct<name:string>>, title string, thread_type string,"
    " messages array<struct<sender_name:string, timestamp_ms:double, content:string,"
    " photos:array<struct<uri:string>>, videos:array<struct<uri:string>>,"
    " audio_files:array<struct<uri:string>>, gifs:array<struct<uri:string>>,"
    " files:array<struct<uri:string>>, sticker:struct<uri:string>,"
    " share:struct<link:string, share_text:string>,"
    " reactions:array<struct<reaction:string, actor:string>>, is_unsent:boolean>>"
)
NORMALIZED_DDL = (
    "participants array<string>, threadName string,"
    " messages array<struct<senderName:string, text:string, timestamp:double, type:string,"
    " media:array<struct<uri:string>>, reactions:array<struct<actor:string, reaction:string>>,"
    " isUnsent:boolean>>"
)
# Certainty of a format: archive layout, numbered file, loose file; base and additions of the others.
ARCHIVE_SCORE, NUMBERED_SCORE, LOOSE_SCORE = 1.0, 0.9, 0.8
NORMALIZED_SCORE, NORMALIZED_ADD = 0.6, 0.2
TRANSCRIPT_SCORE, HEADERS_ADD, HEADERS_MOST, NAME_ADD = 0.5, 0.4, 0.3, 0.15
# Invisible direction marks and byte-order marks phones put into transcripts.
INVISIBLE = r"[\x{200E}\x{200F}\x{202A}-\x{202E}\x{FEFF}]"
HEADER = (
    r"^\[?(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4}),?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"
    r"\s*([AaPp][Mm])?\]?\s*(?:-\s*)?(.*)$"
)
SENDER = r"(?s)^([^:]{1,60}):\s?(.*)$"
OMITTED = (
    "<média omis>", "<médias omis>", "<media omis>", "<média omitted>", "<médias omitted>", "<media omitted>",
    "image omitted", "video omitted", "audio omitted", "sticker omitted", "gif omitted",
)
ATTACHED = r"(?i)\(file attached\)|<attached:"
ATTACHED_KINDS = (
    ("photo", r"(?i)\.(jpe?g|png|webp|heic)\b"),
    ("video", r"(?i)\.(mp4|mov|3gp|mkv)\b"),
    ("voice", r"(?i)\.(opus|m4a|mp3|aac|ogg)\b"),
    ("gif", r"(?i)\.gif\b"),
)
LINK = r"(?i)\bhttps?://"
DELETED = r"(?i)^This message was deleted|^Vous avez supprimé ce message|message was deleted$"
CHAT_NAME = r"(?i)^WhatsApp Chat (?:with|avec|mit|con) (.+)$"
BRACKETED = r"^[^\[]*\[([^\]]+)\]\s+([^:]+):\s+(.*)$"
BRACKETED_TIME = "d/M/yyyy H:m:s"


@dataclass(frozen=True)
class Export:
    """Parsed threads and messages of one or more formats."""

    threads: DataFrame
    messages: DataFrame

    def union(self, other: "Export") -> "Export":
        return Export(
            self.threads.unionByName(other.threads), self.messages.unionByName(other.messages)
        )


# --- paths and names -------------------------------------------------------------------


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def folder_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def _nonblank(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def meta_thread_name(title: Column, path: Column) -> Column:
    """The title, else the archive folder without its trailing id."""
    from_folder = F.regexp_replace(folder_name(path), r"(?i)_[0-9a-z]{6,}$", "")
    return F.coalesce(
        _nonblank(F.trim(words.fix_mojibake(title))), _nonblank(from_folder), F.lit("Unknown")
    )


def normalized_thread_name(name: Column, participants: Column) -> Column:
    """The name without its numeric suffix, else the first participant."""
    bare = F.regexp_replace(words.fix_mojibake(F.coalesce(name, F.lit(""))), r"_\d+$", "")
    return F.coalesce(_nonblank(bare), F.get(participants, F.lit(0)), F.lit("Unknown"))


def chat_thread_name(path: Column) -> Column:
    """The contact in the file name, or in the folder of a bare ``_chat.txt``."""
    base = F.regexp_replace(file_name(path), r"(?i)\.txt$", "")
    parent = folder_name(path)

    def contact(name: Column) -> Column:
        return _nonblank(F.trim(F.regexp_extract(name, CHAT_NAME, 1)))

    from_folder = F.when(
        base.rlike(r"(?i)^_?chat$"), F.coalesce(contact(parent), _nonblank(parent))
    )
    return F.coalesce(contact(base), from_folder, _nonblank(base), F.lit("Unknown"))


# --- recognising formats ---------------------------------------------------------------


def score_meta(path: Column, head: Column) -> Column:
    """1 for the archive layout; a loose file needs both key names."""
    loose = head.contains('"sender_name"') & head.contains('"timestamp_ms"')
    return (
        F.when(~path.rlike(r"(?i)\.json$"), F.lit(0.0))
        .when(path.rlike(ARCHIVE_LAYOUT), F.lit(ARCHIVE_SCORE))
        .when(~loose, F.lit(0.0))
        .when(file_name(path).rlike(r"(?i)message_\d+\.json$"), F.lit(NUMBERED_SCORE))
        .otherwise(F.lit(LOOSE_SCORE))
    )


def score_normalized(path: Column, head: Column) -> Column:
    named = head.contains('"threadName"')
    strings = head.rlike(r'"participants"\s*:\s*\[\s*"')
    known = path.rlike(r"(?i)\.json$") & (head.contains('"senderName"') | named)
    return F.when(
        known,
        F.lit(NORMALIZED_SCORE)
        + F.when(named, F.lit(NORMALIZED_ADD)).otherwise(F.lit(0.0))
        + F.when(strings, F.lit(NORMALIZED_ADD)).otherwise(F.lit(0.0)),
    ).otherwise(F.lit(0.0))


#: Fixed value: so many lines of a text file tell whether it is a transcript.
HEAD_LINES = 40
#: Names under which transcripts are exported.
CHAT_NAMES = (r"(?i)^_?chat\.txt$", r"(?i)^WhatsApp Chat")


def transcript_score(path: Column, headers: Column, lines: Column) -> Column:
    """Share of header lines, with a bonus for the usual names; 0 without a header."""
    bonus = F.lit(NAME_ADD)
    score = (
        F.lit(TRANSCRIPT_SCORE)
        + F.least(F.lit(HEADERS_MOST), headers / F.greatest(F.lit(1), lines) * HEADERS_ADD)
        + F.when(file_name(path).rlike(CHAT_NAMES[0]), bonus).otherwise(F.lit(0.0))
        + F.when(file_name(path).rlike(CHAT_NAMES[1]), bonus).otherwise(F.lit(0.0))
    )
    readable = path.rlike(r"(?i)\.txt$") & (headers > 0)
    return F.when(readable, F.least(F.lit(1.0), score)).otherwise(F.lit(0.0))


def score_chat_text(path: Column, head: Column) -> Column:
    """:func:`transcript_score` of a text in one value."""
    lines = F.slice(F.split(F.regexp_replace(head, INVISIBLE, ""), r"\r?\n"), 1, HEAD_LINES)
    return transcript_score(path, F.size(F.filter(lines, lambda line: line.rlike(HEADER))), F.size(lines))


def route(files: DataFrame) -> DataFrame:
    """Adds ``source_id``, the best-scoring format of each (path, head); null when none fits."""
    path, head = F.col("path"), F.col("head")
    scored = files.withColumn(
        "_best",
        F.greatest(
            F.struct(score_meta(path, head).alias("s"), F.lit(3).alias("p"), F.lit(META).alias("id")),
            F.struct(score_normalized(path, head).alias("s"), F.lit(2).alias("p"), F.lit(NORMALIZED).alias("id")),
            F.struct(score_chat_text(path, head).alias("s"), F.lit(1).alias("p"), F.lit(CHAT_TEXT).alias("id")),
        ),
    )
    return scored.withColumn(
        "source_id", F.when(F.col("_best.s") > 0, F.col("_best.id"))
    ).drop("_best")


def archive_network(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The service an archive names in its paths; unknown when none or both do."""
    low = F.lower(F.col("path"))

    def any_of(marks: Sequence[str]) -> Column:
        cond = F.lit(False)
        for mark in marks:
            cond = cond | low.contains(mark)
        return F.coalesce(F.bool_or(cond), F.lit(False))

    flags = files.groupBy(*by).agg(
        any_of(INSTAGRAM_MARKS).alias("_ig"), any_of(MESSENGER_MARKS).alias("_ms")
    )
    return flags.select(
        *by,
        F.when(F.col("_ig") & ~F.col("_ms"), F.lit("instagram"))
        .when(F.col("_ms") & ~F.col("_ig"), F.lit("messenger"))
        .otherwise(F.lit("unknown"))
        .alias("network"),
    )


# --- JSON formats ----------------------------------------------------------------------


def _naive(ms: Column, zone: str) -> Column:
    instant = F.timestamp_millis(ms.cast("long"))
    return F.from_utc_timestamp(instant, zone).cast("timestamp_ntz")


def _seq(path: Column, pos: Column) -> Column:
    """Order of messages inside a thread when their times are equal."""
    return F.struct(
        path.alias("file"), F.lit(0).cast("long").alias("block"), pos.cast("long").alias("pos")
    )


def no_texts() -> Column:
    return F.array().cast("array<string>")


def _reactions(list_: Column) -> Column:
    named = F.transform(list_, lambda r: words.fix_mojibake(F.coalesce(r["reaction"], F.lit(""))))
    return F.coalesce(F.filter(named, lambda r: r != ""), no_texts())


def meta_kinds(m: Column) -> Column:
    """(msg_type, media_kind) of one message: attachments first, then sticker, link, unsent."""

    def pair(kind: str | Column, media: str | Column) -> Column:
        as_col = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.struct(as_col(kind).alias("msg_type"), as_col(media).alias("media_kind"))

    expr = None
    for field, declared in ATTACHMENTS:
        has = F.coalesce(F.size(m[field]) > 0, F.lit(False))
        by_name = words.media_kind(F.coalesce(F.get(m[field], F.lit(0))["uri"], F.lit("")))
        kind = F.when(by_name == "other", F.lit(declared)).otherwise(by_name)
        expr = F.when(has, pair("media", kind)) if expr is None else expr.when(has, pair("media", kind))
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    return (
        expr.when(filled(m["sticker"]["uri"]), pair("media", "photo"))
        .when(filled(m["share"]["link"]), pair("link", "none"))
        .when(F.coalesce(m["is_unsent"], F.lit(False)), pair("placeholder", "none"))
        .otherwise(pair("text", "none"))
    )


def messages_from_meta(
    files: DataFrame, networks: DataFrame | None = None, zone: str = "UTC", by: Sequence[str] = ()
) -> Export:
    """``files``: ``by``, path, doc (the parsed file). All files of a folder are one thread."""
    docs = files.filter(F.col("doc.messages").isNotNull()).withColumn("thread_key", folder(F.col("path")))
    names = F.transform(
        "doc.participants", lambda p: words.fix_mojibake(F.coalesce(p["name"], F.lit("")))
    )
    people = F.coalesce(F.filter(names, lambda n: n != ""), no_texts())
    kind = F.coalesce(F.col("doc.thread_type"), F.lit(""))
    head = F.struct(
        meta_thread_name(F.col("doc.title"), F.col("path")).alias("thread"),
        people.alias("participants"),
        (kind.isin(*GROUP_THREAD_TYPES) | (F.size(people) > 2)).alias("is_group"),
    )
    threads = (
        docs.groupBy(*by, "thread_key").agg(F.min_by(head, "path").alias("h")).select(*by, "thread_key", "h.*")
    )
    service = archive_network(files, by) if networks is None else networks
    threads = with_group_row(threads, service, by)
    m = F.col("m")
    rows = (
        docs.select(*by, "thread_key", "path", F.posexplode("doc.messages").alias("pos", "m"))
        .filter(m["timestamp_ms"].isNotNull())
        .withColumn("k", meta_kinds(m))
        .select(
            *by,
            F.lit(META).alias("source_id"),
            "thread_key",
            _naive(m["timestamp_ms"], zone).alias("timestamp"),
            _seq(F.col("path"), F.col("pos")).alias("seq"),
            words.fix_mojibake(F.coalesce(m["sender_name"], F.lit("Unknown"))).alias("sender"),
            words.fix_mojibake(
                F.coalesce(m["content"], m["share"]["share_text"], m["share"]["link"], F.lit(""))
            ).alias("text"),
            "k.msg_type",
            "k.media_kind",
            _reactions(m["reactions"]).alias("reaction_list"),
            F.coalesce(m["is_unsent"], F.lit(False)).alias("is_unsent"),
        )
    )
    return Export(threads.withColumn("source_id", F.lit(META)), rows)


def messages_from_normalized(files: DataFrame, zone: str = "UTC", by: Sequence[str] = ()) -> Export:
    """``files``: ``by``, path, doc. One file is one thread."""
    docs = files.filter(F.col("doc.messages").isNotNull()).withColumn("thread_key", F.col("path"))
    people = F.coalesce(F.transform("doc.participants", words.fix_mojibake), no_texts())
    threads = docs.withColumn("participants", people).select(
        *by,
        F.lit(NORMALIZED).alias("source_id"),
        "thread_key",
        F.lit("messenger").alias("network"),
        normalized_thread_name(F.col("doc.threadName"), F.col("participants")).alias("thread"),
        "participants",
        (F.size("participants") > 2).alias("is_group"),
    )
    m = F.col("m")
    media = F.when(
        F.coalesce(F.size(m["media"]) > 0, F.lit(False)),
        words.media_kind(F.coalesce(F.get(m["media"], F.lit(0))["uri"], F.lit(""))),
    ).otherwise(F.lit("none"))
    rows = (
        docs.select(*by, "thread_key", "path", F.posexplode("doc.messages").alias("pos", "m"))
        .filter(m["timestamp"].isNotNull())
        .select(
            *by,
            F.lit(NORMALIZED).alias("source_id"),
            "thread_key",
            _naive(m["timestamp"], zone).alias("timestamp"),
            _seq(F.col("path"), F.col("pos")).alias("seq"),
            words.fix_mojibake(F.coalesce(m["senderName"], F.lit("Unknown"))).alias("sender"),
            words.fix_mojibake(F.coalesce(m["text"], F.lit(""))).alias("text"),
            F.coalesce(m["type"], F.lit("text")).alias("msg_type"),
            media.alias("media_kind"),
            _reactions(m["reactions"]).alias("reaction_list"),
            F.coalesce(m["isUnsent"], F.lit(False)).alias("is_unsent"),
        )
    )
    return Export(threads, rows)


# --- chat text -------------------------------------------------------------------------


def classify_chat_text(text: Column) -> Column:
    """(msg_type, media_kind) of one transcript message."""

    def pair(kind: str, media: Column | str) -> Column:
        value = F.lit(media) if isinstance(media, str) else media
        return F.struct(F.lit(kind).alias("msg_type"), value.alias("media_kind"))

    omitted = F.lit(False)
    for phrase in OMITTED:
        omitted = omitted | F.lower(text).contains(phrase)
    attached = F.lit(None).cast("string")
    for kind, pattern in reversed(ATTACHED_KINDS):
        attached = F.when(text.rlike(pattern), F.lit(kind)).otherwise(attached)
    return (
        F.when(omitted, pair("media", "other"))
        .when(text.rlike(ATTACHED), pair("media", F.coalesce(attached, F.lit("other"))))
        .when(text.rlike(LINK), pair("link", "none"))
        .when(text.rlike(DELETED), pair("placeholder", "none"))
        .otherwise(pair("text", "none"))
    )


def infer_day_first(lines: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """Per file, whether dates start with the day: the first component above 12 decides."""
    first = F.regexp_extract("line", HEADER, 1).try_cast("int")
    second = F.regexp_extract("line", HEADER, 2).try_cast("int")
    verdict = F.when(first > 12, F.lit(True)).when(second > 12, F.lit(False))
    return (
        lines.filter(F.col("line").rlike(HEADER))
        .withColumn("_v", verdict)
        .groupBy(*by)
        .agg(F.coalesce(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("seq"))), F.lit(True)).alias("day_first"))
    )


def chat_timestamp(header: Column, day_first: Column) -> Column:
    """Wall clock of a header line; two-digit years are of this century, days roll over."""

    def part(i: int) -> Column:
        return F.regexp_extract(header, HEADER, i).try_cast("int")

    day = F.when(day_first, part(1)).otherwise(part(2))
    month = F.when(day_first, part(2)).otherwise(part(1))
    year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    half = F.lower(F.regexp_extract(header, HEADER, 7))
    hour = (
        F.when((half == "pm") & (part(4) < 12), part(4) + 12)
        .when((half == "am") & (part(4) == 12), F.lit(0))
        .otherwise(part(4))
    )
    date = F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)
    seconds = hour * 3600 + part(5) * 60 + F.coalesce(part(6), F.lit(0))
    return F.timestamp_seconds(F.unix_date(date).cast("long") * 86400 + seconds).cast("timestamp_ntz")


def fold_continuations(
    lines: DataFrame, starts: Column, by: Sequence[str] = ("path",)
) -> DataFrame:
    """Gives each line the number of the message it belongs to (0 before the first).

    ``lines``: ``by``, seq (struct file, block, pos), line. A file may span many blocks: the
    running count is taken inside each block and carried over by block totals.
    """
    rows = lines.withColumn("_starts", F.coalesce(starts, F.lit(False)).cast("long"))
    cut = [*by, "_block"]
    rows = rows.withColumn("_block", F.col("seq.block"))
    inside = over(cut, F.col("seq")).rowsBetween(Window.unboundedPreceding, 0)
    earlier = over(by, F.col("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy(*cut)
        .agg(F.sum("_starts").alias("_n"))
        .select(*cut, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    )
    numbered = rows.withColumn("_run", F.sum("_starts").over(inside)).join(blocks, cut)
    return numbered.withColumn("message_no", F.col("_run") + F.col("_base")).drop(
        "_run", "_base", "_block", "_starts"
    )


def _joined_lines(by: Sequence[str], kept: DataFrame) -> DataFrame:
    """Lines of one message in order, joined by newlines; the header fields of its first line."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"]
    )
    return kept.groupBy(*by, "message_no").agg(
        F.array_join(ordered, "\n").alias("text"),
        F.min(F.struct("seq", "line"))["line"].alias("header"),
        F.min("seq").alias("seq"),
        F.min_by("part", "seq").alias("first_text"),
    )


def chat_messages(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Transcript messages: sender, time and text with its continuation lines.

    System notices (a header without a sender) are dropped; lines after one belong to the
    message before it.
    """
    key = [*by, "path"]
    clean = lines.withColumn("line", F.regexp_replace("line", INVISIBLE, ""))
    is_header = F.col("line").rlike(HEADER)
    rest = F.regexp_extract("line", HEADER, 8)
    named = is_header & rest.rlike(SENDER)
    kept = (
        fold_continuations(clean.withColumn("_named", named), F.col("_named"), key)
        .filter((F.col("message_no") > 0) & (F.col("_named") | (~is_header & (F.col("line") != ""))))
        .withColumn(
            "part",
            F.when(F.col("_named"), F.regexp_extract(rest, SENDER, 2)).otherwise(F.col("line")),
        )
    )
    messages = _joined_lines(key, kept)
    orders = infer_day_first(clean, key)
    return messages.join(orders, key).select(
        *key,
        "seq",
        chat_timestamp(F.col("header"), F.col("day_first")).alias("timestamp"),
        F.trim(F.regexp_extract(F.regexp_extract("header", HEADER, 8), SENDER, 1)).alias("sender"),
        "text",
        # The kind is decided by the first line, as written.
        classify_chat_text(F.col("first_text")).alias("k"),
    )


def messages_from_chat_text(lines: DataFrame, by: Sequence[str] = ()) -> Export:
    """``lines``: ``by``, path, seq, line."""
    said = chat_messages(lines, by).filter(F.col("timestamp").isNotNull())
    key = [*by, "path"]
    speakers = said.groupBy(*key, "sender").agg(F.min("seq").alias("first"))
    people = speakers.groupBy(*key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("first", "sender"))), lambda p: p["sender"]
        ).alias("participants")
    )
    threads = people.select(
        *by,
        F.lit(CHAT_TEXT).alias("source_id"),
        F.col("path").alias("thread_key"),
        F.lit("whatsapp").alias("network"),
        chat_thread_name(F.col("path")).alias("thread"),
        "participants",
        (F.size("participants") > 2).alias("is_group"),
    )
    rows = said.select(
        *by,
        F.lit(CHAT_TEXT).alias("source_id"),
        F.col("path").alias("thread_key"),
        "timestamp",
        "seq",
        "sender",
        "text",
        "k.msg_type",
        "k.media_kind",
        no_texts().alias("reaction_list"),
        (F.col("k.msg_type") == "placeholder").alias("is_unsent"),
    )
    return Export(threads, rows)


def bracketed_log(lines: DataFrame) -> DataFrame:
    """A bracketed chat log as (datetime, sender, message), continuations folded in.

    A time that cannot be read stays as it was written.
    """
    trimmed = lines.withColumn("line", F.trim("line"))
    starts = F.col("line").rlike(BRACKETED)
    kept = (
        fold_continuations(trimmed, starts)
        .filter(F.col("message_no") > 0)
        .withColumn("part", F.when(starts, F.regexp_extract("line", BRACKETED, 3)).otherwise(F.col("line")))
    )
    said = _joined_lines(["path"], kept)
    written = F.regexp_extract("header", BRACKETED, 1)
    # try_to_timestamp follows the session's time zone both ways, so the digits stay.
    parsed = F.date_format(F.try_to_timestamp(written, F.lit(BRACKETED_TIME)), "yyyy-MM-dd'T'HH:mm:ss")
    return said.select(
        "path",
        "seq",
        F.coalesce(parsed, written).alias("datetime"),
        F.regexp_extract("header", BRACKETED, 2).alias("sender"),
        F.col("text").alias("message"),
    )


# --- files -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Import:
    export: Export
    files: DataFrame  # path and recognised source_id of every readable file

    def unrecognised(self) -> DataFrame:
        return self.files.filter(F.col("source_id").isNull())


def json_head(content: Column) -> Column:
    """What decides the format of a document: its top-level keys, and the keys of its messages.

    Written as a text with the quoted names, so that the scores need not know where it comes from;
    it covers the whole document, however long its list of participants is.
    """
    fields = raw_fields(content)
    of_messages = raw_fields(F.get(raw_items(fields["messages"]), F.lit(0)))
    names = F.concat(
        F.coalesce(F.map_keys(fields), no_texts()), F.coalesce(F.map_keys(of_messages), no_texts())
    )
    quoted = F.array_join(F.transform(names, lambda n: F.concat(F.lit('"'), n, F.lit('"'))), " ")
    strings = F.coalesce(fields["participants"].rlike(r'^\s*\[\s*"'), F.lit(False))
    return F.concat(quoted, F.when(strings, F.lit(' "participants": ["')).otherwise(F.lit("")))


def transcript_head(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, path, headers, lines) of the first lines of each text file; only those are moved.

    Where the name is a transcript's, a header further down counts as one among them.
    """
    is_header = F.regexp_replace("line", INVISIBLE, "").rlike(HEADER)
    key = [*by, "path"]
    first = top_k(lines.filter("seq.block = 0"), HEAD_LINES, F.col("seq.pos"), by=key)
    heads = first.groupBy(*key).agg(F.count_if(is_header).alias("headers"), F.count(F.lit(1)).alias("lines"))
    name = file_name(F.col("path"))
    named = lines.filter(name.rlike(CHAT_NAMES[0]) | name.rlike(CHAT_NAMES[1]))
    anywhere = named.groupBy("path").agg(F.max(is_header.cast("long")).alias("_any"))
    headers = F.greatest(F.col("headers"), F.coalesce("_any", F.lit(0)))
    return heads.join(anywhere, "path", "left").select(*key, headers.alias("headers"), "lines")


def read_messages(
    spark: SparkSession, paths: str | Sequence[str], zone: str = "UTC", owner: str | None = None
) -> Import:
    """Reads a drop of files of any mix of services; each file goes to its best format.

    ``owner``: a pattern whose group names the person in a path; then all tables have that column,
    and the network of an archive is decided for each person. It is decided from paths alone.
    """
    documents, by = with_owner(read_contents(spark, paths), owner)
    json_files = route(documents.withColumn("head", json_head(F.col("content"))))
    lines, _ = with_owner(read_lines(spark, paths), owner)
    heads = transcript_head(lines, by)
    score = transcript_score(F.col("path"), F.col("headers"), F.col("lines"))
    text_files = heads.withColumn("source_id", F.when(score > 0, F.lit(CHAT_TEXT)))
    named = [*by, "path", "source_id"]
    files = json_files.select(named).unionByName(text_files.select(named))
    network = archive_network(json_files.select(*by, "path").unionByName(heads.select(*by, "path")), by)

    def parsed(source: str, ddl: str) -> DataFrame:
        doc = F.from_json("content", T.StructType.fromDDL(ddl))
        return json_files.filter(F.col("source_id") == source).select(*by, "path", doc.alias("doc"))

    chats = lines.join(text_files.filter(F.col("source_id") == CHAT_TEXT).select("path"), "path", "left_semi")
    export = (
        messages_from_meta(parsed(META, META_DDL), network, zone, by)
        .union(messages_from_normalized(parsed(NORMALIZED, NORMALIZED_DDL), zone, by))
        .union(messages_from_chat_text(chats, by))
    )
    return Import(export, files)


def import_report(threads: DataFrame, messages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threads and messages per service. A thread is known by person, format and key."""
    key = [*by, "source_id", "thread_key"]
    counted = messages.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return (
        threads.join(counted, key, "left")
        .groupBy(*by, "network")
        .agg(
            F.count(F.lit(1)).alias("threads"),
            F.sum(F.coalesce("_n", F.lit(0))).alias("messages"),
        )
    )


# --- the message table -----------------------------------------------------------------

NATURAL_KEY = ("network", "thread", "timestamp", "sender")


def new_messages(
    incoming: DataFrame, stored: DataFrame, dedupe_within: bool = False, by: Sequence[str] = ()
) -> DataFrame:
    """Incoming messages that are not stored yet; null text equals null text.

    Copies inside one batch are kept unless ``dedupe_within``.
    """
    left, right = incoming.alias("i"), stored.alias("s")
    cond = F.col("i.text").eqNullSafe(F.col("s.text"))
    for c in (*by, *NATURAL_KEY):
        cond = cond & (F.col(f"i.{c}") == F.col(f"s.{c}"))
    fresh = left.join(right, cond, "left_anti")
    return fresh.dropDuplicates([*by, *NATURAL_KEY, "text"]) if dedupe_within else fresh


def append_messages(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    dedupe_within: bool = False,
    by: Sequence[str] = (),
    batch: str | None = None,
) -> list[str]:
    """Appends what is new; importing the same archive again changes nothing. Returns what was opened.

    Rows lie under the name of their batch. A batch that is sent again, because it broke off half
    way, is compared with the other batches and written over its own rows. Which of a month's
    batches can hold a message is known from a filter of their keys (:mod:`batches`), so only those
    are opened, and a month's batches are merged before there are many.
    """
    batch = batch or uuid.uuid4().hex
    keys = [*by, *NATURAL_KEY, "text"]
    rows = incoming.withColumn("month", F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("none")))
    months = [r["month"] for r in rows.select("month").distinct().collect()]  # as many as the calendar has
    opened = batches.may_hold(spark, path, rows, keys, months, batch)
    if opened:
        rows = new_messages(rows, spark.read.parquet(*opened).select(*keys), dedupe_within, by)
    elif dedupe_within:
        rows = rows.dropDuplicates(keys)
    rows.write.mode("overwrite").partitionBy("month").parquet(f"{path}/batch={batch}")
    batches.commit(spark, path, batch, keys)
    for month in months:
        batches.merge(spark, path, month, keys)
    return opened


def stored_messages(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """The message table with a dense index over everything stored."""
    return message_index(spark.read.parquet(path).drop("month", "batch"), by)
