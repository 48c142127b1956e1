"""JSON files that are one big array, read by many tasks.

Where an entry ends depends on everything before: a bracket in a string is text. So a file is scanned
twice in blocks. First each block says how it would change the state of the reader, for both states it
may begin in: inside a string or not. Put together in order, the few numbers of each block give the
state that every block begins in. In the second scan each block then cuts its entries at true borders;
pieces of entries that reach over block borders are joined.

Blocks come from Spark's text source with ``}`` as the end of a record, so any store that Spark reads
will do. A file counts as an array when it begins with ``[`` and its brackets close.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daytrail.plans.ranking import over
from daytrail.session import cut_lineage
from daytrail.sources.files import plain_path

_STATE = "path string, block long, quotes long, out long, inside long, opens boolean"
_CUT = "path string, block long, part int, text string"


def pieces(spark: SparkSession, paths: str | Sequence[str], **options: object) -> DataFrame:
    """(path, block, pos, value): stretches of text up to each ``}``, in order of ``pos`` in a block."""
    return (
        spark.read.options(recursiveFileLookup=True, **options).option("lineSep", "}").text(paths)
        .select(
            plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"), "value",
        )
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, bytes]]:
    """(path, block, number of the first row, text) of neighbouring rows of one block."""
    paths, blocks = batch.column("path").to_pylist(), batch.column("block").to_pylist()
    first = 0
    for i in range(1, len(paths) + 1):
        if i == len(paths) or (paths[i], blocks[i]) != (paths[first], blocks[first]):
            texts = batch.column("value").slice(first, i - first).to_pylist()
            yield paths[first], blocks[first], first, ("}".join(texts) + "}").encode()
            first = i


def marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: it, whether the quotes before it are odd in number, and its step in depth."""
    data = np.frombuffer(text, np.uint8)
    place = np.arange(len(data))
    # The run of backslashes before a byte, from the last byte that is none.
    other = np.maximum.accumulate(np.where(data != 92, place, -1))
    before = np.concatenate([[-1], other[:-1]])
    escaped = (place - 1 - before) % 2 == 1
    quotes = (data == 34) & ~escaped
    odd = (np.cumsum(quotes) - quotes) % 2 == 1
    step = np.isin(data, (91, 123)).astype(np.int64) - np.isin(data, (93, 125))
    return data, odd, step


def block_states(found: DataFrame) -> DataFrame:
    """(path, block, in_string, depth): what each block of an array begins in."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, block, _, text in _runs(batch):
                data, odd, step = marks(text)
                quotes = int(odd[-1]) ^ int(data[-1] == 34)
                start = text.removeprefix(b"\xef\xbb\xbf").lstrip()[:1]
                rows.append((path, block, quotes, int(step[~odd].sum()), int(step[odd].sum()), start == b"["))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "block", "quotes", "out", "inside", "opens"), r, strict=True)) for r in rows])

    # A batch's numbers, in order; a block has few batches, a file few blocks.
    each = found.select("path", "block", "value").mapInArrow(scan, _STATE).withColumn("n", F.monotonically_increasing_id())
    each = cut_lineage(each)
    order = over(["path"], F.col("block"), F.col("n"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turned = each.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    turned = turned.withColumn("step", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("out")))
    whole = over(["path"])
    deep = turned.withColumns({
        "depth": F.coalesce(F.sum("step").over(before), F.lit(0)),
        "end": F.sum("step").over(whole),
        "array": F.min_by("opens", F.struct("block", "n")).over(whole),
        "first": F.row_number().over(over(["path", "block"], F.col("n"))),
    })
    # The record after the last one has no } of its own, but was given one.
    return deep.filter("first = 1 AND array AND end = -1").select("path", "block", "in_string", "depth")


def array_entries(spark: SparkSession, paths: str | Sequence[str], **options: object) -> DataFrame:
    """(path, entry): the text of each entry of the arrays; ``options`` go to Spark's text source."""
    found = pieces(spark, paths, **options)
    states = cut_lineage(block_states(found))
    # In order again, should the join have moved blocks.
    placed = found.join(states, ["path", "block"]).sortWithinPartitions("path", "block", "pos")
    cut = cut_lineage(placed.select("path", "block", "value", "in_string", "depth").mapInArrow(_cut_entries, _CUT))
    # Two pieces a block at most are left over.
    order = over(["path"], F.col("block"), F.col("part"))
    pieces_of = cut.filter("part > 0").withColumn("n", F.sum((F.col("part") == 2).cast("int")).over(order))
    joined = pieces_of.groupBy("path", "n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "text"))), lambda p: p["text"]), "").alias("text")
    )
    every = cut.filter("part = 0").select("path", "text").unionByName(joined.select("path", "text"))
    return every.select("path", F.regexp_replace("text", r"^\s+|\s+$", "").alias("entry")).filter("entry <> ''")


def _cut_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (part 0) of each block, the end of one begun before (1) and the begin of one that goes on (2)."""
    here, quoted, depth, rest, borders = None, False, 0, b"", 0

    def left() -> list[dict]:
        # What no border closed: all of a block inside one entry, or the begin of the next.
        if here is None or depth < 1:
            return []
        return [{"path": here[0], "block": here[1], "part": 2 if borders else 1, "text": rest.decode()}]

    for batch in batches:
        out = []
        for path, block, row, text in _runs(batch):
            if (path, block) != here:
                out += left()
                here, rest, borders = (path, block), b"", 0
                quoted, depth = bool(batch.column("in_string")[row].as_py()), batch.column("depth")[row].as_py()
            data, odd, step = marks(text)
            step = np.where(odd == quoted, step, 0)  # quotes before are even: as the block began
            level = depth + np.cumsum(step)
            outside = odd == quoted
            border = outside & (((data == 44) & (level == 1)) | ((step == 1) & (level == 1)) | ((step == -1) & (level == 0)))
            begin = 0
            for at in np.flatnonzero(border).tolist():
                entry = rest + text[begin:at]
                # Before the first bracket of a file there is no entry.
                if level[at] - step[at] >= 1 and (entry.strip() or not borders):
                    out.append({"path": path, "block": block, "part": 0 if borders else 1, "text": entry.decode()})
                rest, begin, borders = b"", at + 1, borders + 1
            rest += text[begin:]
            quoted ^= bool(int(odd[-1]) ^ int(data[-1] == 34))
            depth = int(level[-1])
        yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("text", pa.string())]))
    yield pa.RecordBatch.from_pylist(left(), pa.schema([("path", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("text", pa.string())]))
