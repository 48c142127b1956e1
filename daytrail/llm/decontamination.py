"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are lower-cased and cut into words (letters, digits and all characters
beyond ASCII). Runs of ``SEED`` words are the seeds. A document is scanned once: what its seeds
don't touch is left out, so that little of a corpus goes on. Documents and items that share seeds
are joined on them, and each such pair is tiled: the longest match of words that no tile covers
yet is marked, again and again, until no match of ``SEED`` words is left. Matches are found with
Karp-Rabin hashes of word runs and then compared word by word. As tiles may lie in any order, a
passage whose sentences were moved is found too. A document is contaminated when its tiles cover
``COVERAGE`` of an item.

Between the scan and the join stands a filter of ``FILTER_BITS`` bits over the seeds of the
benchmark. However large the benchmark, the filter keeps its size; when it fills up, more goes to
the join, and the result stays the same.

Defined cases: null and empty texts are clean; items of fewer than ``SEED`` words, or null, match
nothing; items with equal ids are tiled apart; equal texts share one decision, which every row
gets; columns besides ids and texts are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.llm.textscan import LOOSE, Words, mixed, pieces, utf8, windows
from daytrail.session import cut_lineage

SEED = 5
COVERAGE = 0.8
FILTER_BITS = 1 << 23
#: Stands for everything between two touched stretches; no word hashes to it in practice.
GAP = 0


def word_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """The hashes of each text's words."""
    raw, starts, ends = utf8(column)
    for i, j in pieces(starts, ends):
        if ends[i:j].max() == starts[i]:
            yield from (np.zeros(0, np.uint64) for _ in range(i, j))
            continue
        words = Words(raw, starts[i:j], ends[i:j], LOOSE)
        for k in range(j - i):
            yield words.hash[words.first[k] : words.first[k + 1]]


def text_key(text: Column) -> Column:
    return F.md5(text.cast("string").cast("binary"))


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words): items of ``SEED`` words or more; ``item`` tells rows apart."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.view(np.int64) for w in word_hashes(batch.column("text"))]
            out = pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(words, pa.list_(pa.int64()))], ["item_id", "words"]
            )
            yield out.filter(pa.array([len(w) >= SEED for w in words], pa.bool_()))

    rows = benchmark.select("item_id", F.lower(F.col("text").cast("string")).alias("text")).distinct()
    found = rows.mapInArrow(scan, f"item_id {kind}, words array<long>")
    return found.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words")


def item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item, times)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column("item").to_pylist(), batch.column("words"), strict=True):
                seeds = windows(np.array(words.as_py(), np.int64).view(np.uint64), SEED).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seeds), pa.array(np.full(len(seeds), item))], ["seed", "item"]
                )

    found = items.select("item", "words").mapInArrow(scan, "seed long, item long")
    return found.groupBy("seed", "item").agg(F.count(F.lit(1)).alias("times"))


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """One bit for each hash of a seed, as at most ``FILTER_BITS / 64`` numbers."""
    bit = f"pmod(seed, {FILTER_BITS})"
    rows = (
        seeds.groupBy(F.expr(f"CAST({bit} DIV 64 AS INT)").alias("word"))
        .agg(F.expr(f"bit_or(shiftleft(1L, CAST({bit} % 64 AS INT)))").alias("bits"))
        .collect()
    )
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for row in rows:
        bits[row["word"]] = row["bits"]
    return bits


def touched(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(key, words, places, seeds) of the texts with a seed that may be in the benchmark.

    ``words`` are the words under such seeds with a GAP between stretches; ``places`` their
    numbers in the text.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: set[str] = set()
            keys, words, places, seeds = [], [], [], []
            for key, hashes in zip(batch.column("key"), word_hashes(batch.column("text")), strict=True):
                runs = windows(hashes, SEED)
                at = (runs & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                hit = np.flatnonzero((bits[at >> 6] >> (at & 63)) & 1)
                if not len(hit) or key.as_py() in known:
                    continue
                known.add(key.as_py())
                place = np.unique((hit[:, None] + np.arange(SEED)).ravel())
                breaks = np.flatnonzero(np.diff(place) > 1) + 1
                keys.append(key.as_py())
                words.append(np.insert(hashes[place], breaks, GAP).view(np.int64))
                places.append(np.insert(place, breaks, -1))
                seeds.append(np.unique(runs[hit]).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(words, longs), pa.array(places, longs), pa.array(seeds, longs)],
                ["key", "words", "places", "seeds"],
            )

    rows = docs.select(text_key(F.col("text")).alias("key"), F.lower(F.col("text").cast("string")).alias("text"))
    found = rows.where("text IS NOT NULL").mapInArrow(
        scan, "key string, words array<long>, places array<long>, seeds array<long>"
    )
    return found.dropDuplicates(["key"])


def _matches(text: list[int], item: list[int], free_text: list[bool], free_item: list[bool], least: int):
    """Maximal matches of free words as (length, place in the item, place in the text)."""
    def runs(words: list[int], free: list[bool]):
        hashes = windows(np.array(words, np.int64).view(np.uint64), least).tolist()
        blocked = np.flatnonzero(~np.array(free, bool))
        bad = set((blocked[:, None] - np.arange(least)).ravel().tolist())
        return [(h, i) for i, h in enumerate(hashes) if i not in bad]

    places = defaultdict(list)
    for h, j in runs(text, free_text):
        places[h].append(j)
    for h, i in runs(item, free_item):
        for j in places.get(h, ()):
            if i and j and free_item[i - 1] and free_text[j - 1] and item[i - 1] == text[j - 1]:
                continue  # part of a match that starts before
            n = 0
            while (
                i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n]
                and free_item[i + n] and free_text[j + n]
            ):
                n += 1
            if n >= least:
                yield n, i, j


def greedy_tiles(text: list[int], item: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (length, place in the item, place in the text); GAP matches nothing.

    Of matches of one length the first in the item, then in the text, is marked first.
    """
    free_text, free_item = [w != GAP for w in text], [w != GAP for w in item]
    tiles = []
    while True:
        found = sorted(_matches(text, item, free_text, free_item, least), key=lambda m: (-m[0], *m[1:]))
        if not found:
            return tiles
        for n, i, j in found:
            if n < found[0][0]:
                break
            if all(free_item[i : i + n]) and all(free_text[j : j + n]):
                free_item[i : i + n] = free_text[j : j + n] = [False] * n
                tiles.append((n, i, j))


def tiled_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(key, item_id, covered, item_words, tiles): texts that cover ``coverage`` of an item.

    ``tiles``: (length, place in the item, place in the text), in words.
    """
    items = cut_lineage(item_words(benchmark))
    seeds = cut_lineage(item_seeds(items))
    found = cut_lineage(touched(docs, seed_filter(seeds)))
    sizes = items.select("item", F.size("words").alias("item_words"))
    pairs = (
        found.select("key", F.explode("seeds").alias("seed"))
        .join(seeds, "seed")
        .groupBy("key", "item").agg((SEED * F.sum("times")).alias("most"))
        .join(sizes, "item")
        .where(F.col("most") >= coverage * F.col("item_words"))  # tiles can't cover more
        .select("key", "item")
    )
    both = pairs.join(found.drop("seeds"), "key").join(items.withColumnRenamed("words", "item_words"), "item")
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                item, places = row["item_words"], row["places"]
                tiles = greedy_tiles(row["words"], item)
                covered = sum(n for n, _, _ in tiles)
                if tiles and covered >= coverage * len(item):
                    rows.append((
                        row["key"], row["item_id"], covered, len(item),
                        [{"length": n, "item_place": i, "text_place": places[j]} for n, i, j in tiles],
                    ))
            tiles_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("length", "item_place", "text_place")]))
            types = [pa.string(), batch.schema.field("item_id").type, pa.int64(), pa.int64(), tiles_type]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["key", "item_id", "covered", "item_words", "tiles"],
            )

    return both.select("key", "words", "places", "item_id", "item_words").mapInArrow(
        tile,
        f"key string, item_id {kind}, covered long, item_words long, "
        "tiles array<struct<length: long, item_place: long, text_place: long>>",
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, contaminated, item_id, share, n_items), a row for each row of ``docs``.

    ``item_id`` is the item covered most (ties: the smallest), ``share`` how much of it.
    """
    hits = tiled_pairs(docs, benchmark, coverage)
    share = (F.col("covered") / F.col("item_words")).alias("share")
    best = hits.select("key", "item_id", share).groupBy("key").agg(
        F.max("share").alias("share"), F.min_by("item_id", F.struct(-F.col("share"), "item_id")).alias("item_id"),
        F.count(F.lit(1)).alias("n_items"),
    )
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    return rows.join(cut_lineage(best), "key", "left").select(
        "doc_id",
        F.col("share").isNotNull().alias("contaminated"),
        "item_id",
        F.coalesce("share", F.lit(0.0)).alias("share"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with all their columns."""
    keys = cut_lineage(tiled_pairs(docs, benchmark, coverage).select("key").distinct())
    rows = docs.select(F.struct("*").alias("row"), text_key(F.col("text")).alias("key"))
    return rows.join(keys, "key", "left_anti").select("row.*")
