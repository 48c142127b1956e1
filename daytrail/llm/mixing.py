"""Mixing sources to target weights with hash-threshold histograms.

Every document has 60 hash bits. Words are summed by source and by the first bits of the hash;
running sums over those few buckets show in which bucket a source's budget ends. Only that
bucket is opened, by its next bits, until it holds one hash. The result is a threshold per
source, so the mix is a filter: nothing is sorted, and a rerun takes the same documents. Budgets
of several epochs nest: whole repeats come first, the threshold decides the last, partial one.

Defined cases: a null text has no words; a null source is a source of its own, last in order; a
null id hashes as ''; rows with one id stand or fall together; sources without words have target
0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrail.llm.columns import hash60, word_count
from daytrail.session import cut_lineage

#: Hash bits per histogram level; five levels make up the 60 bits.
BITS, LEVELS = 12, 5
#: No document is repeated more often.
MOST = 3


def source_key(source: Column) -> Column:
    """A key without nulls; real names sort by code point and before the null source."""
    return F.coalesce(F.concat(F.lit("n"), source), F.lit("o"))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(src, source_size) to (src, source_size, target).

    Weights repeat along the sources in order. A target is ``least(most * size, level * weight)``
    with the one level at which targets add up to all sizes: sorted by the level at which a source
    is full, the level is what the full ones leave, divided by the weights of the others. One row
    a source goes through one task.
    """
    by_name = Window.orderBy("src")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    weighed = totals.withColumn("weight", weight.cast("double")).withColumn(
        "full_at", most * F.col("source_size") / F.col("weight")
    )
    by_level = Window.orderBy("full_at", "src")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / F.sum("weight").over(rest)
    leveled = weighed.withColumn("level", level).withColumn(
        "level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything)
    )
    return leveled.select(
        "src",
        "source_size",
        F.least(most * F.col("source_size").cast("double"), F.col("level") * F.col("weight")).alias("target"),
    )


def _prefix(level: int) -> Column:
    return F.shiftright("h", 60 - BITS * level)


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, source_size, target, repeats, bar): documents with ``h < bar`` are taken once more.

    ``sizes``: (src, h, size). A level sums words by the next 12 bits, in the open bucket alone.
    ``done`` is what lies below the open bucket. Levels end when no open bucket has two hashes.
    """
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.withColumn("repeats", repeats.cast("long")).select(
        "*",
        (F.col("target") - F.col("repeats") * F.col("source_size")).alias("budget"),
        F.lit(0).cast("long").alias("open"),
        F.lit(0).cast("double").alias("done"),
    )
    for level in range(1, LEVELS + 1):
        # Joined on the bucket as well, so that a hot source does not meet in one task.
        inside = sizes if level == 1 else sizes.withColumn("open", _prefix(level - 1)).join(
            state.select("src", "open"), ["src", "open"]
        )
        buckets = inside.groupBy("src", _prefix(level).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        order = Window.partitionBy("src").orderBy("bucket")
        ended = (
            buckets.join(state.select("src", "source_size", "target", "repeats", "budget", "done"), "src")
            .withColumn("upto", F.col("done") + F.sum("words").over(order))
            # The first bucket whose end passes the budget; else the last one.
            .withColumn("past", F.when(F.col("upto") > F.col("budget"), F.col("bucket")))
            .groupBy("src", "source_size", "target", "repeats", "budget")
            .agg(
                F.coalesce(F.min("past"), F.max("bucket")).alias("open"),
                F.min_by(
                    F.struct(F.col("upto") - F.col("words"), "words", "low", "high"),
                    F.coalesce(F.col("past"), 4 * F.lit(2**60) - F.col("bucket")),
                ).alias("b"),
            )
        )
        state = cut_lineage(
            ended.select(
                "src", "source_size", "target", "repeats", "budget", "open",
                F.col("b.col1").alias("done"), "b.words", "b.low", "b.high",
            )
        )
        if level == LEVELS or state.where("low < high").isEmpty():
            break
    # The last document is taken when the sum comes nearer to the budget with it.
    nearer = F.abs(F.col("done") + F.col("words") - F.col("budget")) < F.abs(F.col("done") - F.col("budget"))
    bar = F.when(nearer, F.col("high") + 1).otherwise(F.col("low"))
    return state.select("src", "source_size", "target", "repeats", bar.alias("bar"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source, source_size, target, times, taken), a row for each document."""
    sizes = cut_lineage(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            source_key(F.col("source")).alias("src"),
            word_count(F.col("text")).alias("size"),
            hash60(F.col("doc_id")).alias("h"),
        )
    )
    totals = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    bars = thresholds(sizes.select("src", "h", "size"), source_targets(totals))
    times = (F.col("repeats") + (F.col("h") < F.col("bar")).cast("long")).alias("times")
    return sizes.join(bars, "src").select(
        "doc_id", "size", "source", "source_size", "target", times, (F.col("size") * times).alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, with all their columns."""
    row = docs.select(
        F.struct("*").alias("row"),
        source_key(F.col("source")).alias("src"),
        hash60(F.col("doc_id")).alias("h"),
    )
    sizes = cut_lineage(
        docs.select(
            source_key(F.col("source")).alias("src"),
            word_count(F.col("text")).alias("size"),
            hash60(F.col("doc_id")).alias("h"),
        )
    )
    totals = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    bars = thresholds(sizes, source_targets(totals)).select("src", "repeats", "bar")
    times = F.col("repeats") + (F.col("h") < F.col("bar")).cast("long")
    return (
        row.join(bars, "src")
        .where(times > 0)
        .select("row", F.explode(F.sequence(F.lit(1), times)).alias("nth"))
        .select("row.*")
    )
