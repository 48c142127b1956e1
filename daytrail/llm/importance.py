"""Importance resampling towards a target: array-scored weights, then a distributed radix sort.

Every word falls into one of ``BUCKETS`` buckets (CRC-32 of its UTF-8 bytes). Corpus and target
are counted by bucket; the gain of a bucket is how much more likely the target makes it. The
gains are one array of ``BUCKETS`` numbers that every task holds, so a document's weight is read
off in a second scan. A Gumbel number made from the id turns the highest scores into a draw
without replacement.

Ranks come from a least-significant-digit radix sort. Rows carry their place. A pass cuts the
places into blocks of ``BLOCK`` rows; each block counts its digits and numbers its rows within a
digit in the order of their places, which keeps a pass stable; running sums of the counts over
(digit, block) give each block's offset for a digit, and offset plus number is the new place.
After the last digit of the leading key the places are the ranks. Every block has at most
``BLOCK`` rows whatever the keys are, so equal or skewed keys burden no task, and places are
written out with the rows, so a lost executor changes no order. The counts of scores show first
which score the draw ends at; rows below it can't be drawn and are not sorted.

Defined cases: a null or empty text has no features and weight 0; it is not drawn. A null id makes
its random number from an empty id and goes after all ids of its score. Rows with equal id and score
are ranked in any order. An empty table gives no rows; with an empty target all gains count no
target words. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.llm.textscan import LOOSE, Spans, pieces, utf8
from daytrail.plans.ranking import over
from daytrail.session import cut_lineage

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bits of a digit, and rows (as bits of the place) that are numbered together.
DIGIT, BLOCK = 11, 16


# --- buckets of words -----------------------------------------------------------------------


def crc_table() -> np.ndarray:
    """CRC-32 of each byte, by its reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def crc32s(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of many byte spans at once (A to Z lower-cased), a byte of all of them a step."""
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    going = np.flatnonzero(end > start)
    at, state, k = start[going], crc[going], 0
    while len(going):
        state = _CRC[(state ^ _LOWER[raw[at + k]]) & np.uint32(255)] ^ (state >> np.uint32(8))
        k += 1
        more = end[going] - start[going] > k
        if not more.all():
            done = ~more
            crc[going[done]] = state[done]
            going, at, state = going[more], at[more], state[more]
    return crc ^ np.uint32(0xFFFFFFFF)


def bucketed(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For stretches of texts i to j: the bucket of each word, and each text's first word."""
    raw, starts, ends = utf8(column)
    for i, j in pieces(starts, ends):
        if ends[i:j].max() == starts[i]:
            yield i, j, np.zeros(0, np.int64), np.zeros(j - i + 1, np.int64)
            continue
        words = Spans(raw, starts[i:j], ends[i:j], LOOSE)
        yield i, j, crc32s(raw, words.start, words.end).astype(np.int64) % buckets, words.first


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all words of the column ``text``; a task gives one row a bucket at most."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket, _ in bucketed(batch.column("text"), buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(scan, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, thousandths of the logarithm of how likely the target makes it."""
    spark = docs.sparkSession
    counted = spark.range(buckets).withColumnRenamed("id", "bucket")
    for name, df in (("s", docs), ("t", target)):
        counted = counted.join(bucket_counts(df, buckets).withColumnRenamed("n", name), "bucket", "left")
    counted = counted.fillna(0, ["s", "t"])
    # Windows over all buckets: BUCKETS rows in one task.
    s, t, all_s, all_t = (
        c.cast("double") for c in (F.col("s"), F.col("t"), F.sum("s").over(over([])), F.sum("t").over(over([])))
    )
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return counted.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight): the mean gain of a text's words, floored."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.zeros(batch.num_rows, np.int64)
            total = np.zeros(batch.num_rows, np.int64)
            for i, j, bucket, first in bucketed(batch.column("text"), len(gains)):
                upto = np.concatenate([[0], np.cumsum(gains[bucket])])
                number[i:j] = np.diff(first)
                total[i:j] = upto[first[1:]] - upto[first[:-1]]
            mean = np.floor_divide(total, np.maximum(number, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(number), pa.array(mean)], ["doc_id", "n_features", "weight"]
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number, floored, the same for an id on every run."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


# --- radix sort -----------------------------------------------------------------------------


def counting_pass(rows: DataFrame, digit: Column) -> DataFrame:
    """One stable pass: ``place`` becomes the row's place by ``digit``, former places deciding ties."""
    dealt = rows.withColumns({"_block": F.shiftrightunsigned("place", BLOCK), "_digit": digit.cast("int")})
    counts = dealt.groupBy("_block", "_digit").agg(F.count(F.lit(1)).alias("_n"))
    # A digit has one row a block. Digits before it are at most 2 ** DIGIT sums.
    within = F.sum("_n").over(over(["_digit"], "_block")) - F.col("_n")
    lower = counts.groupBy("_digit").agg(F.sum("_n").alias("_all")).select(
        "_digit", (F.sum("_all").over(over([], "_digit")) - F.col("_all")).alias("_lower")
    )
    offsets = counts.withColumn("_within", within).join(F.broadcast(lower), "_digit").select(
        "_block", "_digit", (F.col("_lower") + F.col("_within")).alias("_offset")
    )
    number = F.row_number().over(over(["_block", "_digit"], "place")) - 1
    placed = dealt.repartition("_block").withColumn("_number", number).join(offsets, ["_block", "_digit"])
    return placed.select(
        (F.col("_offset") + F.col("_number")).cast("long").alias("place"),
        *[c for c in rows.columns if c != "place"],
    )


def radix_ranked(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``place`` from 0 in the order of ``keys`` (longs, ascending, nulls last).

    Only bits in which the keys differ make digits. Each pass is written to the shared folder.
    """
    biased = {k: F.col(k).bitwiseXOR(F.lit(-(1 << 63))) for k in keys}
    placed = cut_lineage(rows.withColumn("place", F.monotonically_increasing_id()))
    spans = placed.agg(*[f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.min, F.max)],
                       *[F.max(F.col(k).isNull()).alias(f"null_{k}") for k in keys]).first()
    sign = 1 << 63
    passes = []
    for k in reversed(keys):
        low, high = spans[f"min_{k}"], spans[f"max_{k}"]
        if low is not None:
            bits = ((low + sign) ^ (high + sign)).bit_length()
            mask = (1 << DIGIT) - 1
            passes += [
                F.coalesce(F.shiftrightunsigned(biased[k], shift).bitwiseAND(F.lit(mask)), F.lit(0))
                for shift in range(0, bits, DIGIT)
            ]
        if spans[f"null_{k}"]:
            passes.append(F.col(k).isNull().cast("int"))
    for digit in passes or [F.lit(0)]:
        placed = cut_lineage(counting_pass(placed, digit))
    return placed


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Adds ``rank`` to (doc_id, n_features, weight, score): null where a document is not drawn."""
    able = F.col("n_features") >= least_words
    # Scores lie within some ten thousands whatever the corpus, so their counts go to one task.
    counts = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # Window over scores, not rows.
    upto = counts.withColumn("upto", F.sum("n").over(over([], F.col("score").desc())))
    found = upto.select(
        "*", F.floor(percent * F.sum("n").over(over([])) / 100).alias("wanted")
    ).agg(F.max("wanted").alias("wanted"), F.max(F.when(F.col("upto") >= F.col("wanted"), F.col("score"))).alias("bar")).first()
    wanted = found["wanted"] or 0
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    near = able & (F.col("score") >= found["bar"])
    rows = scored.where(near).withColumns({"_down": -F.col("score"), "_id": F.col("doc_id").cast("long")})
    ranked = radix_ranked(rows, ["_down", "_id"])
    rank = F.when(F.col("place") < wanted, F.col("place") + 1)
    taken = ranked.select(*scored.columns, rank.alias("rank"))
    return taken.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document."""
    gains = np.zeros(BUCKETS, np.int64)
    for row in bucket_gains(docs, target).collect():  # BUCKETS rows
        gains[row["bucket"]] = row["gain"]
    scored = weights(docs, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id")))
    return drawn(cut_lineage(scored))
