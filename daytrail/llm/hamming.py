"""Exact top-k search over binary codes with incremental multi-index hashing.

A vector's code holds the signs of its numbers, one bit each. Equal codes are one entry with the
``k`` smallest ids that have it (more can't be among the k nearest, since ties go to the smallest
id). Entries are dealt by hash into blocks of about ``BLOCK`` codes. A block is indexed by several
segments of its codes: per segment a table from value to entries. A query looks up each segment's
value, then all values one bit off, two bits off and so on. After radius r, every code within
``segments * (r + 1) - 1`` bits has been met: a code further apart in every segment than r is at
least ``segments * (r + 1)`` away. When the kth verified distance is no larger, the query is done.

Queries travel in groups of ``GROUP`` to every block (a stated query set against all rows, in
blocks); a block's answer is at most k codes a query, and the answers are merged per query. Tasks
hold a block and a group of queries, whatever the table's size.

Defined cases: a null vector, or one that has nulls or not ``bits`` numbers, is not searched nor
searches; NaN counts as positive; equal vectors are told apart by id; fewer than k rows give all
of them; a null id is never a query, and last among ties; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrail.session import cut_lineage

BLOCK, GROUP = 1 << 13, 128


def sign_code(vector: Column, bits: int) -> Column:
    """Bit i is set where number i is above 0; null where there is no whole vector."""
    bit = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bit, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    whole = (F.size(vector) == bits) & ~F.exists(vector, lambda x: x.isNull())
    return F.when(whole, code)


class SegmentIndex:
    """Multi-index tables over distinct codes of ``bits`` bits."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes = codes
        # Segments as wide as the number of codes has bits, so that a value has about one code.
        width = max(1, min(bits, 16, int(len(codes)).bit_length() - 1))
        self.count = -(-bits // width)
        edges = np.linspace(0, bits, self.count + 1).round().astype(int)
        self.shifts, self.widths = edges[:-1], np.diff(edges)
        self.order, self.first = [], []
        for shift, wide in zip(self.shifts, self.widths, strict=True):
            value = self.value(codes, shift, wide)
            self.order.append(np.argsort(value, kind="stable"))
            self.first.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << wide))]))
        self.flips: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def value(codes: np.ndarray, shift: int, wide: int) -> np.ndarray:
        return ((codes >> np.uint64(shift)) & np.uint64((1 << wide) - 1)).astype(np.int64)

    def near(self, wide: int, radius: int) -> np.ndarray:
        """All values of ``wide`` bits with ``radius`` bits set."""
        key = (int(wide), radius)
        if key not in self.flips:
            bits = itertools.combinations(range(wide), radius)
            self.flips[key] = np.array([sum(1 << b for b in c) for c in bits], np.int64)
        return self.flips[key]

    def search(self, query: np.uint64, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distances) of all codes up to the kth distance, ties at that distance included."""
        k = min(k, len(self.codes))
        seen = np.zeros(len(self.codes), bool)
        found, distances = [], []
        for radius in range(int(self.widths.max()) + 1):
            for order, first, shift, wide in zip(self.order, self.first, self.shifts, self.widths, strict=True):
                if radius > wide:
                    continue
                values = int((int(query) >> int(shift)) & ((1 << int(wide)) - 1)) ^ self.near(wide, radius)
                begin, size = first[values], first[values + 1] - first[values]
                hit = size > 0
                begin, size = begin[hit], size[hit]
                at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
                new = order[at]
                new = new[~seen[new]]
                seen[new] = True
                found.append(new)
                distances.append(np.bitwise_count(self.codes[new] ^ query).astype(np.int64))
            have = np.concatenate(distances)
            if len(have) >= k:
                kth = np.partition(have, k - 1)[k - 1]
                if kth <= self.count * (radius + 1) - 1:
                    break
        else:
            kth = have.max()
        keep = have <= kth
        return self.codes[np.concatenate(found)[keep]], have[keep]


def _best(codes: np.ndarray, distances: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k places that are first by distance, then by smallest id of the code."""
    return np.lexsort((ids, distances))[:k]


def search_blocks(entries: DataFrame, queries: DataFrame, k: int, bits: int) -> DataFrame:
    """(query, code, distance): the k best codes of each block for each query."""
    blocks = F.greatest(F.lit(1), F.ceil(F.lit(entries.count()) / BLOCK)).cast("int")
    dealt = entries.withColumn("block", F.pmod(F.xxhash64("code"), blocks).cast("int"))
    packed = dealt.groupBy("block").agg(
        F.collect_list(F.struct("code", F.get("ids", F.lit(0)).alias("low"))).alias("held")  # about BLOCK entries
    )
    groups = F.greatest(F.lit(1), F.ceil(F.lit(queries.count()) / GROUP)).cast("int")
    asked = (
        queries.withColumn("part", F.pmod(F.xxhash64("code", F.lit(7)), groups))
        .groupBy("part").agg(F.collect_list("code").alias("asked"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    )
    both = packed.join(asked, "block").select("held", "asked").repartition(F.xxhash64("held", "asked"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, asked_now in zip(batch.column("held"), batch.column("asked"), strict=True):
                held = held.values
                codes = held.field("code").to_numpy(zero_copy_only=False).view(np.uint64)
                # A code's smallest id decides ties; a missing one comes last.
                low = held.field("low").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                by_code = np.argsort(codes)
                index = SegmentIndex(codes, bits)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for query in asked_now.values.to_numpy(zero_copy_only=False).view(np.uint64):
                    near, distance = index.search(query, k)
                    ids = low[by_code[np.searchsorted(codes, near, sorter=by_code)]]
                    best = _best(near, distance, ids, k)
                    out.append((np.full(len(best), query), near[best], distance[best]))
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0].view(np.int64)), pa.array(columns[1].view(np.int64)), pa.array(columns[2])],
                    ["query", "code", "distance"],
                )

    return both.mapInArrow(search, "query long, code long, distance long")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, bits: int = 64) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the k rows nearest to each query row."""
    coded = cut_lineage(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            sign_code(F.col("embedding"), bits).alias("code"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        ).where("code IS NOT NULL")
    )
    # k smallest ids of each code, cut before the rows of a code meet.
    first = Window.partitionBy("code").orderBy(F.col("vec_id").asc_nulls_last())
    entries = cut_lineage(
        coded.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k)
        .groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))
    )
    queries = cut_lineage(coded.where("asks").select("code").distinct())
    found = search_blocks(entries, queries, k, bits)
    merge = Window.partitionBy("query").orderBy("distance", F.col("neighbor_id").asc_nulls_last())
    ranked = (
        found.join(entries, "code")
        .select("query", "distance", F.explode("ids").alias("neighbor_id"))
        .withColumn("rank", F.row_number().over(merge))
        .where(F.col("rank") <= k)
    )
    return (
        coded.where("asks").select("vec_id", F.col("code").alias("query"))
        .join(ranked, "query")
        .select("vec_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", "distance")
    )
