"""Files of a drop: all of them, whatever their names, and JSON texts read leniently.

Spark's file sources skip every path with a name that starts with ``_`` or ``.``; archives hold such
folders (handles) and files (``_chat.txt``). Those files are found by a walk that runs in tasks, one
level of folders a job, and read in tasks; everything else goes through Spark's own reader.

JSON is parsed in steps that lose little: a text to raw entries (strings), an entry to a map of raw
values, a value to a type with ``try_cast``. What does not fit is null; its neighbours stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrail.session import cut_lineage

BLOCK_BYTES = 64 * 1024 * 1024
LINES_PER_BATCH = 20_000
LINE_SCHEMA = "path string, seq struct<file:string, block:bigint, pos:bigint>, line string"


def plain_path(path: Column) -> Column:
    """File paths arrive URL-encoded; names are matched as people wrote them."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _opened(uri: str):
    """(file system, path inside it) of a URI whose name is not URL-encoded."""
    import urllib.parse

    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    full = f"{scheme}:///{rest.lstrip('/')}" if scheme == "file" else uri
    return fs.FileSystem.from_uri(urllib.parse.quote(full, safe="/:"))


def _roots(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[str, bool]]:
    """(URI, is a folder) of each named path; patterns are expanded."""
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        for status in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []:
            name = status.getPath().toUri()
            uri = f"{name.getScheme()}://{name.getAuthority() or ''}{name.getPath()}"
            found.append((uri, status.isDirectory()))
    return found


def hidden_files(spark: SparkSession, paths: str | Sequence[str], suffix: str) -> DataFrame:
    """(uri) of the files below ``paths`` that Spark's reader skips, by suffix in any case."""
    schema = "uri string, folder boolean, hidden boolean"

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for uri, hidden in zip(batch["uri"], batch["hidden"], strict=True):
                system, inside = _opened(uri)
                rows = [
                    (f"{uri.rstrip('/')}/{x.base_name}", x.type == fs.FileType.Directory, hidden or x.base_name[:1] in "_.")
                    for x in system.get_file_info(fs.FileSelector(inside))
                ]
                yield pd.DataFrame(rows, columns=["uri", "folder", "hidden"])

    def starts_hidden(uri: str) -> bool:
        return uri.rstrip("/").rpartition("/")[2][:1] in ("_", ".")

    roots = [(uri, folder, starts_hidden(uri)) for uri, folder in _roots(spark, paths)]
    found = level = spark.createDataFrame(roots, schema)
    while True:
        folders = level.where("folder")
        if folders.isEmpty():
            break
        level = cut_lineage(folders.repartition("uri").mapInPandas(listed, schema))
        found = found.union(level)
    wanted = ~F.col("folder") & F.col("hidden") & F.lower("uri").endswith(suffix)
    return found.where(wanted).select("uri").distinct()


def _pattern(suffix: str) -> str:
    """A glob for a suffix in any case."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def read_lines(spark: SparkSession, paths: str | Sequence[str], suffix: str = ".txt") -> DataFrame:
    """Lines of text files with their place in the file. Large files are split into blocks."""
    path = plain_path(F.col("_metadata.file_path"))
    listed = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", _pattern(suffix))
        .text(paths)
        .select(
            path.alias("path"),
            F.struct(
                path.alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("pos"),
            ).alias("seq"),
            F.regexp_replace("value", r"\r$", "").alias("line"),
        )
    )

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for batch in batches:
            for uri in batch["uri"]:
                system, inner = _opened(uri)
                rows, read = [], 0
                with system.open_input_stream(inner) as raw:
                    for n, line in enumerate(io.TextIOWrapper(raw, "utf-8", "replace", newline="\n")):
                        rows.append((uri, {"file": uri, "block": read // BLOCK_BYTES, "pos": n}, line.rstrip("\r\n")))
                        read += len(line)
                        if len(rows) == LINES_PER_BATCH:
                            yield pd.DataFrame(rows, columns=["path", "seq", "line"])
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "seq", "line"])

    hidden = hidden_files(spark, paths, suffix).repartition("uri").mapInPandas(stream, LINE_SCHEMA)
    return listed.unionByName(hidden)


def read_contents(spark: SparkSession, paths: str | Sequence[str], suffix: str = ".json") -> DataFrame:
    """(path, content) of whole files. JSON has no split points: a file is one value in one task."""
    listed = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", _pattern(suffix))
        .option("wholetext", True)
        .text(paths)
        .select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("content"))
    )

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["uri"]:
                system, inner = _opened(uri)
                with system.open_input_stream(inner) as raw:
                    yield pd.DataFrame({"path": [uri], "content": [raw.read().decode("utf-8", "replace")]})

    hidden = hidden_files(spark, paths, suffix).repartition("uri").mapInPandas(whole, "path string, content string")
    return listed.unionByName(hidden)


# --- lenient JSON ------------------------------------------------------------------------


def raw_items(text: Column) -> Column:
    """The elements of a JSON array as texts; null when the text is no array."""
    bare = F.ltrim(F.regexp_replace(text, "^\\x{FEFF}", ""))
    return F.when(bare.rlike(r"(?s)^\s*\["), F.from_json(bare, "array<string>"))


def raw_fields(text: Column) -> Column:
    """The fields of a JSON object as a map of texts; null when the text is no object.

    Of repeated names the last one counts.
    """
    fields = F.from_json(text, "map<string,string>")
    names = F.map_keys(fields)
    once = F.array_distinct(names)
    last = lambda name: F.element_at(F.filter(F.map_entries(fields), lambda e: e["key"] == name), -1)["value"]
    unique = F.when(F.size(names) == F.size(once), fields).otherwise(F.map_from_arrays(once, F.transform(once, last)))
    return F.when(text.rlike(r"(?s)^\s*\{"), unique)


def typed(raw: Column, kind: str) -> Column:
    """A raw value as a type, null when it does not fit. Whole numbers may be written as 1000.0, and
    of a number with a fraction the whole part is taken."""
    if kind in ("bigint", "int"):
        return raw.try_cast("double").try_cast(kind)
    return raw.try_cast(kind)


def owner_of(path: Column, pattern: str) -> Column:
    """The person a file belongs to: what the group of ``pattern`` finds in its path, or null."""
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def with_owner(files: DataFrame, owner: str | None) -> tuple[DataFrame, list[str]]:
    """``files`` with an owner column when a pattern for it is given, and the columns to carry."""
    if owner is None:
        return files, []
    return files.withColumn("owner", owner_of(F.col("path"), owner)), ["owner"]
