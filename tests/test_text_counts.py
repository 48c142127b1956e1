"""Counts over texts: every code point, and the cost of plain text."""

import re
import time

from pyspark.sql import functions as F

from daytrail.functions import text


def test_every_code_point(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    parts = [points[i : i + 4096] for i in range(0, len(points), 4096)]
    table = spark.createDataFrame([(i, "".join(map(chr, p))) for i, p in enumerate(parts)], "id int, text string")
    got = {r["id"]: (r["e"], r["w"]) for r in table.select("id", text.count_emoji(F.col("text")).alias("e"), text.count_words(F.col("text")).alias("w")).collect()}
    ranges = [(int(a, 16), int(b or a, 16)) for a, b in re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", text.PICTOGRAPHIC)]
    space = {9, 10, 11, 12, 13, 32, 0xA0, 0xFEFF, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x1680, *range(0x2000, 0x200B)}
    for i, p in enumerate(parts):
        words = sum(c not in space and (k == 0 or p[k - 1] in space) for k, c in enumerate(p))
        assert got[i] == (sum(any(a <= c <= b for a, b in ranges) for c in p), words)


def test_plain_text_is_not_tried_against_every_range(spark):
    rows = spark.range(40, numPartitions=1).select(F.repeat(F.lit("plain words of text "), 5000).alias("text")).localCheckpoint()

    def took(count):
        rows.agg(F.sum(count)).collect()
        begun = time.perf_counter()
        assert rows.agg(F.sum(count)).first()[0] == 0
        return time.perf_counter() - begun

    assert 2 * took(text.count_emoji(F.col("text"))) < took(F.regexp_count("text", F.lit(text.PICTOGRAPHIC)))
