"""Which committed batches of a table can hold a key, and merging them before there are many.

A table's rows lie in ``batch=<name>/month=<month>`` folders. Beside them, ``_log`` holds for every
such folder the bits of a key filter (Bloom, two bits a key, about sixteen bits per row): rows of
(word, bits) that a new batch joins with the hashes of its own keys. So only folders that hold one of
its keys, or seem to, are opened; the log itself is read for the batch's months alone.

When a month has more than ``MOST`` folders they become one. The merged folder's entry names those
that it replaces; they are removed after it is committed, or by whoever finds them next, so a merge
that broke off is never counted twice by readers of :func:`folders`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 8
BITS_PER_ROW = 16
#: A filter has at most so many bits (16 MB); beyond, more folders are opened in vain.
MOST_BITS = 1 << 27

_ENTRY = "word long, bits long, size long, replaces array<string>"


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _filesystem(spark, path)
    return system.exists(where)


def _names(spark: SparkSession, path: str) -> list[str]:
    """The batches that a folder of the log names."""
    system, where = _filesystem(spark, path)
    if not system.exists(where):
        return []
    return sorted(
        s.getPath().getName().removeprefix("batch=") for s in system.listStatus(where)
        if s.getPath().getName().startswith("batch=")
    )


def _remove(spark: SparkSession, path: str) -> None:
    system, where = _filesystem(spark, path)
    system.delete(where, True)


def _data(path: str, batch: str, month: str) -> str:
    return f"{path}/batch={batch}/month={month}"


def _entry(path: str, batch: str, month: str) -> str:
    return f"{path}/_log/month={month}/batch={batch}"


def _log(spark: SparkSession, path: str, month: str, names: Sequence[str]) -> DataFrame:
    each = [
        spark.read.schema(_ENTRY).parquet(_entry(path, n, month)).select("*", F.lit(n).alias("batch"), F.lit(month).alias("month"))
        for n in names
    ]
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df)
    return out


def folders(spark: SparkSession, path: str, month: str) -> list[str]:
    """The batches of a month, without those that a merge has replaced."""
    names = _names(spark, f"{path}/_log/month={month}")
    if not any(n.startswith("merged-") for n in names):
        return names
    merged = [n for n in names if n.startswith("merged-")]
    heads = _log(spark, path, month, merged).filter("word = -1").collect()  # one row a merge
    gone = {x for r in heads for x in r["replaces"]} & set(names)
    for name in gone:
        _remove(spark, _entry(path, name, month))
        _remove(spark, _data(path, name, month))
    return [n for n in names if n not in gone]


def _bits_of(hashes: Column, size: Column) -> Column:
    """Two bits for each key, or one where they fall together."""
    return F.array_distinct(F.array(F.pmod(hashes, size), F.pmod(F.shiftrightunsigned(hashes, 21), size)))


def _marked(rows: DataFrame, keys: Sequence[str], size: Column) -> DataFrame:
    return rows.withColumn("_hash", F.xxhash64(*keys)).withColumn("_bit", F.explode(_bits_of(F.col("_hash"), size)))


def may_hold(
    spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], months: Sequence[str], batch: str
) -> list[str]:
    """Folders that can hold one of the keys of ``rows`` (which has ``month``), other than the batch's own."""
    found = []
    for month in months:
        names = [n for n in folders(spark, path, month) if n != batch]
        if not names:
            continue
        entries = _log(spark, path, month, names).filter("word >= 0")
        # A folder has one size; there are few folders.
        sizes = entries.select("batch", "size").distinct().collect()
        each = F.explode(F.array(*[F.struct(F.lit(r["batch"]).alias("batch"), F.lit(r["size"]).alias("size")) for r in sizes]))
        asked = rows.filter(F.col("month") == month).select(F.xxhash64(*keys).alias("_hash")).distinct()
        asked = asked.withColumn("at", each).select("_hash", "at.*").withColumn("_bits", _bits_of(F.col("_hash"), F.col("size")))
        hits = (
            asked.select("batch", "_hash", F.size("_bits").alias("_need"), F.explode("_bits").alias("_bit"))
            .withColumn("word", F.expr("_bit DIV 64"))
            .join(entries.select("batch", "word", "bits"), ["batch", "word"])
            .filter(F.expr("shiftrightunsigned(bits, CAST(_bit % 64 AS INT)) & 1 = 1"))
            .groupBy("batch", "_hash").agg((F.count(F.lit(1)) == F.max("_need")).alias("all"))
            .filter("all")
        )
        found += [_data(path, r["batch"], month) for r in hits.select("batch").distinct().collect()]
    return sorted(p for p in found if exists(spark, p))


def commit(spark: SparkSession, path: str, batch: str, keys: Sequence[str], months: Sequence[str] | None = None, replaces: Sequence[str] = ()) -> None:
    """Writes the filters of a batch's folders, from the rows that were written."""
    root, where = _filesystem(spark, f"{path}/batch={batch}")
    there = [s.getPath().getName().removeprefix("month=") for s in root.listStatus(where) if s.getPath().getName().startswith("month=")]
    for month in sorted(there if months is None else set(there) & set(months)):
        rows = spark.read.parquet(_data(path, batch, month))
        size = min(MOST_BITS, max(1024, 1 << (rows.count() * BITS_PER_ROW - 1).bit_length()))
        words = (
            _marked(rows.select(*keys), keys, F.lit(size).cast("long"))
            .groupBy(F.expr("_bit DIV 64").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, CAST(_bit % 64 AS INT)))").alias("bits"))
            .select("word", "bits", F.lit(size).cast("long").alias("size"), F.lit(None).cast("array<string>").alias("replaces"))
        )
        head = spark.createDataFrame([(-1, 0, size, list(replaces))], _ENTRY)
        words.unionByName(head).coalesce(1).write.mode("overwrite").parquet(_entry(path, batch, month))


def merge(spark: SparkSession, path: str, month: str, keys: Sequence[str]) -> None:
    """Makes one folder of a month's, when there are more than ``MOST``."""
    names = folders(spark, path, month)
    if len(names) <= MOST:
        return
    merged = "merged-" + hashlib.sha256("|".join(names).encode()).hexdigest()[:16]
    rows = spark.read.parquet(*[p for n in names if exists(spark, p := _data(path, n, month))])
    rows.write.mode("overwrite").parquet(_data(path, merged, month))
    commit(spark, path, merged, keys, [month], names)
    folders(spark, path, month)  # removes what was replaced
