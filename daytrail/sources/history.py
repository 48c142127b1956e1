"""Streaming-history exports to the plays table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daytrail.functions import labels
from daytrail.plans.ordered import ordered_pass, range_chunk
from daytrail.sources import big_arrays
from daytrail.sources.files import raw_fields, raw_items, read_contents, typed, with_owner

# The field names of the export.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("ms_played", T.LongType()),
        T.StructField("conn_country", T.StringType()),
        T.StructField("ip_addr", T.StringType()),
        T.StructField("master_metadata_track_name", T.StringType()),
        T.StructField("master_metadata_album_artist_name", T.StringType()),
        T.StructField("master_metadata_album_album_name", T.StringType()),
        T.StructField("spotify_track_uri", T.StringType()),
        T.StructField("episode_name", T.StringType()),
        T.StructField("episode_show_name", T.StringType()),
        T.StructField("spotify_episode_uri", T.StringType()),
        T.StructField("reason_start", T.StringType()),
        T.StructField("reason_end", T.StringType()),
        T.StructField("shuffle", T.BooleanType()),
        T.StructField("skipped", T.BooleanType()),
        T.StructField("offline", T.BooleanType()),
        T.StructField("offline_timestamp", T.LongType()),
        T.StructField("incognito_mode", T.BooleanType()),
    ]
)
# Checked in this order, so that e.g. "Windows ... ios" is Windows. A text that is
# just "osx" is macOS as well.
PLATFORM_MARKS = (
    ("Android", ("android",)),
    ("Windows", ("windows",)),
    ("iOS", ("ios",)),
    ("macOS", ("os x", "macos")),
    ("Web", ("web", "browser")),
)
OTHER_PLATFORM = "Other"


def entries_from_contents(contents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entries of files (``by``, path, content), with ``source_file``, the name of the file.

    A value of an odd type is read as far as it goes and is null else; an entry stays whatever its
    other values are. Only an entry without ``ts`` is none. A file that is no array gives nothing.
    """
    return _typed_entries(contents.select(*by, "path", F.explode(raw_items(F.col("content"))).alias("_entry")), by)


def _typed_entries(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Texts of entries (``by``, path, _entry) as columns."""
    fields = entries.select(*by, F.element_at(F.split("path", "/"), -1).alias("source_file"), "_entry").select(
        *by, "source_file", raw_fields(F.col("_entry")).alias("_f")
    )
    values = [typed(F.col("_f")[x.name], x.dataType.simpleString()).alias(x.name) for x in RAW_SCHEMA]
    return fields.select(*by, *values, "source_file").filter(F.col("ts").isNotNull())


def unread_files(contents: DataFrame) -> DataFrame:
    """(path) of the files that are no JSON array."""
    return contents.filter(raw_items(F.col("content")).isNull()).select("path")


def read_streaming_history(spark: SparkSession, paths: str | Sequence[str], owner: str | None = None) -> DataFrame:
    """Entries of all files. ``owner``: a pattern whose group names the person in a path."""
    files, by = with_owner(read_contents(spark, paths), owner)
    return entries_from_contents(files, by).drop("source_file")


def read_big_history(spark: SparkSession, paths: str | Sequence[str], owner: str | None = None, **options: object) -> DataFrame:
    """As :func:`with_source_file`, for files too big for one task: each is read in blocks by many.

    Hidden files are left out, and a file counts by its brackets (see :mod:`big_arrays`).
    """
    files, by = with_owner(big_arrays.array_entries(spark, paths, **options), owner)
    entries = _typed_entries(files.withColumnRenamed("entry", "_entry"), by)
    return entries.withColumn("ts", F.col("ts").try_cast("timestamp"))


def with_source_file(spark: SparkSession, paths: str | Sequence[str], owner: str | None = None) -> DataFrame:
    """Entries tagged with the name of the file they came from."""
    files, by = with_owner(read_contents(spark, paths), owner)
    return entries_from_contents(files, by).withColumn("ts", F.col("ts").try_cast("timestamp"))


def history_span(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Files, rows and first and last instant of a load."""
    return history.groupBy(*by).agg(
        F.countDistinct("source_file").alias("files"),
        F.count(F.lit(1)).alias("entries"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def clean_platform(raw: Column) -> Column:
    """Six labels; anything unknown, empty or missing is 'Other'."""
    text = F.lower(raw)
    expr = None
    for label, marks in PLATFORM_MARKS:
        cond = F.lit(False)
        for mark in marks:
            cond = cond | text.contains(mark)
        if label == "macOS":
            cond = cond | (text == "osx")
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(OTHER_PLATFORM))


def plays_from_raw(raw: DataFrame, time_zone: str = "UTC", by: Sequence[str] = ()) -> DataFrame:
    """Typed plays: podcast fields folded in, skips recomputed, hearings numbered.

    ``play_count`` numbers the hearings of one title and artist in order of time, those without
    a readable time first. It is an ordered pass over sampled ranges of that order, so a title
    heard all the time, or never at a known time, is not one task.
    """
    podcast = F.coalesce(F.col("episode_name") != "", F.lit(False))

    def pick(episode: str, track: str | None) -> Column:
        other = F.col(track) if track else F.lit(None).cast("string")
        return F.when(podcast, F.col(episode) if episode else F.lit(None).cast("string")).otherwise(other)

    title = F.when(
        podcast, F.concat_ws("|", "episode_name", F.coalesce("episode_show_name", F.lit("undefined")))
    ).otherwise(
        F.concat_ws(
            "|",
            F.coalesce("master_metadata_track_name", F.lit("null")),
            F.coalesce("master_metadata_album_artist_name", F.lit("null")),
        )
    )
    instant = F.col("ts").try_cast("timestamp")
    prepared = raw.withColumns(
        {"_instant": instant, "_title": title, "_tie": F.xxhash64(*[F.col(c) for c in raw.columns])}
    )
    order = [F.col("_instant"), F.col("_tie")]
    counted = ordered_pass(
        prepared,
        keys=[*by, "_title"],
        order=order,
        chunk=range_chunk(prepared, order),
        running={"_count": F.lit(1)},
    )
    local = F.from_utc_timestamp("_instant", time_zone).cast("timestamp_ntz")
    no_text = F.lit(None).cast("string")
    return counted.select(
        *by,
        local.alias("timestamp"),
        local.cast("date").alias("date"),
        F.col("ms_played").cast("int").alias("ms_played"),
        pick("episode_name", "master_metadata_track_name").alias("track_name"),
        pick("episode_show_name", "master_metadata_album_artist_name").alias("artist_name"),
        F.when(podcast, no_text).otherwise(F.col("master_metadata_album_album_name")).alias("album_name"),
        pick("spotify_episode_uri", "spotify_track_uri").alias("track_uri"),
        "platform",
        clean_platform(F.col("platform")).alias("platform_clean"),
        F.col("conn_country").alias("country"),
        "ip_addr",
        F.lower(F.coalesce("reason_end", F.lit(""))).isin(*labels.INTENTIONAL_STOP).alias("skipped"),
        "shuffle",
        "offline",
        "reason_start",
        "reason_end",
        "episode_name",
        "episode_show_name",
        F.col("spotify_episode_uri").alias("episode_uri"),
        F.coalesce("incognito_mode", F.lit(False)).alias("incognito_mode"),
        F.when(podcast, F.lit("podcast")).otherwise(F.lit("track")).alias("media_type"),
        F.col("_count").cast("int").alias("play_count"),
        (F.col("_count") == 1).alias("is_first_play"),
    )


def write_plays(plays: DataFrame, path: str) -> None:
    """Replaces the plays table: rows equal in all columns once, partitioned by year.

    ``play_count`` is a column, and copies of one play were numbered before, so they stay.
    """
    unique = plays.distinct().withColumn("year", F.year("date"))
    unique.write.mode("overwrite").partitionBy("year").parquet(path)
