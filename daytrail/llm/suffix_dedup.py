"""Removal of repeated byte strings with a distributed suffix array over chosen suffixes.

A byte goes when a string of ``length`` bytes that covers it starts anywhere else too. Sorting the
suffix of every byte would move hundreds of times the corpus, so suffixes start at anchors: in each
window of ``length`` bytes the anchor is the place whose next ``seed`` bytes have the least hash.
Equal windows have equal anchors, so a repeated window is found where its anchor is compared. The
windows of one anchor follow each other; they are told apart by r, the bytes before the anchor.

1. Anchors are scanned and their seeds counted; seeds met at one place only can't be in a repeat.
   The others reach the next scan as a filter of fixed size, which sets costs and no results.
2. For each such anchor the bytes that its windows span make one row, equal rows counted as one.
3. Rows are range-partitioned by the suffix at the anchor with sampled splitters. A bucket is sorted
   by multikey quicksort on 8-byte words; common prefixes of neighbours give, for each r, the runs of
   suffixes that agree on the rest of the window, and within a run the r bytes before the anchor
   decide (as 64-bit hashes). Windows that two suffixes share are repeats.
4. Suffixes whose leading bytes reach over a bucket's border are compared across it: they go to the
   next round, where each row covers half as many r, so that more leading bytes are shared by all
   its windows. A leading string in a third of all documents is thus split further and further, down
   to single windows, which are counted by hash. A bucket never holds more than about ``BUCKET`` rows.
5. Repeats go back to the places of their rows, and each text is cut once.

Equal texts are scanned as one and repeat as a whole. Everything is stated by key and place, not by
the order of rows, so a lost executor changes nothing.

Defined cases: a null text is empty; texts below ``length`` bytes lose nothing; equal texts of
``length`` bytes or more lose all; ids may be missing or repeated, as texts are told apart by their
digest; a row per row of the table is returned; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.llm import textscan
from daytrail.llm.divergence import passes, prefix_filter
from daytrail.llm.textscan import mixed, pieces, utf8
from daytrail.session import cut_lineage

#: Rows of a bucket; below that many rows there is one bucket.
BUCKET = 1 << 15
#: Segments of at most this size are sorted by comparing their bytes.
SMALL = 64
#: Low bits of a hash that give way to the place, so that the leftmost of equal hashes is least.
PLACE = 22

_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclasses.dataclass(frozen=True)
class Rule:
    """A repeat has ``length`` bytes; anchors are chosen by ``seed`` bytes."""

    length: int = 400
    seed: int = 64

    @property
    def most(self) -> int:
        """The largest number of bytes of a window before its anchor."""
        return self.length - self.seed


# --- anchors --------------------------------------------------------------------------------


class Anchors:
    """Anchors of neighbouring texts, with the windows that they stand for.

    ``doc``, ``at`` (place in ``text``), ``low`` and ``high`` (bytes before the anchor in its last and
    first window) and ``seed`` (hash of the seed); ``start`` says where each text starts in ``text``.
    """

    def __init__(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, rule: Rule):
        self.text, self.start = text, start
        n, width = len(text), rule.most + 1
        windows = n - rule.length + 1
        if windows <= 0:
            self.doc = self.at = self.low = self.high = np.zeros(0, np.int64)
            self.seed = np.zeros(0, np.uint64)
            return
        powers, self._inverse = textscan._powers(textscan._BASE, n), textscan._powers(textscan._INVERSE, n)
        self._prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[text] * powers, out=self._prefix[1:])
        place = np.arange(n - rule.seed + 1)
        seeds = mixed((self._prefix[rule.seed :] - self._prefix[: -rule.seed]) * self._inverse[: len(place)])
        mask = np.uint64((1 << PLACE) - 1)
        value = (seeds & ~mask) | place.astype(np.uint64)
        least = (_sliding_least(value, width) & mask).astype(np.int64)
        # Windows inside one text.
        doc = np.repeat(np.arange(len(start)), end - start)
        window = np.flatnonzero(np.arange(windows) + rule.length <= np.repeat(end, end - start)[:windows])
        if not len(window):
            self.doc = self.at = self.low = self.high = np.zeros(0, np.int64)
            self.seed = np.zeros(0, np.uint64)
            return
        at, doc = least[window], doc[window]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.append(first[1:], len(window)) - 1
        self.doc, self.at = doc[first], at[first]
        self.high, self.low = self.at - window[first], self.at - window[last]
        self.seed = seeds[self.at]

    def kept(self, some: np.ndarray) -> Anchors:
        for name in ("doc", "at", "low", "high", "seed"):
            setattr(self, name, getattr(self, name)[some])
        return self

    def span_hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._prefix[end] - self._prefix[begin]) * self._inverse[begin] + (end - begin).astype(np.uint64))


def _sliding_least(value: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from least-so-far both ways in blocks of ``width``."""
    blocks = -(-len(value) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(value)] = value
    grid = padded.reshape(blocks, width)
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(value) - width + 1
    return np.minimum(onward[:n], upto[width - 1 : width - 1 + n])


def scanned(column: pa.Array, rule: Rule) -> Iterator[tuple[int, int, Anchors]]:
    """(number of the first text, bytes of it left out before, anchors); long texts come in parts."""
    raw, starts, ends = utf8(column)
    for i, j in pieces(starts, ends):
        low, high = int(starts[i]), int(ends[i:j].max())
        most = textscan.PIECE
        if high - low <= most:
            begin = starts[i:j] - low
            yield i, 0, Anchors(raw[low:high], begin, np.maximum(ends[i:j] - low, begin), rule)
            continue
        # Several texts of a piece fit; one that doesn't is alone. Parts overlap by all but one window.
        for k in range(i, j):
            for part in range(int(starts[k]), int(ends[k]), most):
                text = raw[part : min(part + most + rule.length - 1, int(ends[k]))]
                yield k, part - int(starts[k]), Anchors(text, np.zeros(1, np.int64), np.array([len(text)]), rule)


def _keys(column: pa.Array) -> np.ndarray:
    """The first 8 bytes of each digest."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint64)[::2] if joined else np.zeros(0, np.uint64)


def text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def texts_of(docs: DataFrame) -> DataFrame:
    """(key, text) of each row, null as ''."""
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(text_key().alias("key"), "text")


def live_seeds(texts: DataFrame, rule: Rule) -> np.ndarray:
    """A filter of the seeds that anchor windows at two places or more."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch.column("key"))
            for i, before, found in scanned(batch.column("text"), rule):
                if len(found.at):
                    place = _places(found, keys, i, before)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.seed.view(np.int64)), pa.array(place.view(np.int64))], ["prefix", "place"]
                    )

    met = texts.mapInArrow(scan, "prefix long, place long")
    seeds = met.groupBy("prefix").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    return prefix_filter(seeds.where("a <> b"))


def _places(found: Anchors, keys: np.ndarray, i: int, before: int) -> np.ndarray:
    """A number for (text, place) of each anchor."""
    at = found.at - found.start[found.doc] + before
    return mixed(keys[found.doc + i] ^ mixed(at.astype(np.uint64) + np.uint64(1)))


# --- rows: what the windows of an anchor span ------------------------------------------------


def _contexts(found: Anchors, rule: Rule) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """Distinct rows of the anchors: a place of each, the row of each anchor, bytes and digests."""
    begin, end = found.at - found.high, found.at + rule.length - found.low
    same = mixed(found.span_hash(begin, end) ^ mixed((found.high * 65_536 + found.low).astype(np.uint64) + np.uint64(1)))
    _, first, row = np.unique(same, return_index=True, return_inverse=True)
    data = found.text.tobytes()
    spans = [data[s:e] for s, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
    digests = [
        hashlib.blake2b(span, digest_size=16, salt=b"%d,%d" % (low, high)).digest()
        for span, low, high in zip(spans, found.low[first].tolist(), found.high[first].tolist(), strict=True)
    ]
    return first, row, spans, digests


def context_rows(texts: DataFrame, bits: np.ndarray, rule: Rule) -> DataFrame:
    """(cid, ctx, low, high, many): distinct rows, and whether one is met at two places or more."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch.column("key"))
            for i, before, found in scanned(batch.column("text"), rule):
                found.kept(passes(bits, found.seed))
                if not len(found.at):
                    continue
                place = _places(found, keys, i, before).view(np.int64)
                first, row, spans, digests = _contexts(found, rule)
                a, b = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
                np.minimum.at(a, row, place)
                np.maximum.at(b, row, place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array(spans, pa.binary()), pa.array(found.low[first], pa.int32()),
                     pa.array(found.high[first], pa.int32()), pa.array(a), pa.array(b)],
                    ["cid", "ctx", "low", "high", "a", "b"],
                )

    met = texts.mapInArrow(scan, "cid binary, ctx binary, low int, high int, a long, b long")
    return met.groupBy("cid").agg(
        F.first("ctx").alias("ctx"), F.first("low").alias("low"), F.first("high").alias("high"),
        (F.min("a") != F.max("b")).alias("many"),
    )


def context_places(texts: DataFrame, bits: np.ndarray, rule: Rule) -> DataFrame:
    """(cid, key, at, more): where the rows are met, neighbouring places of one row as one."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, before, found in scanned(batch.column("text"), rule):
                found.kept(passes(bits, found.seed))
                if not len(found.at):
                    continue
                _, row, _, digests = _contexts(found, rule)
                at = found.at - found.start[found.doc] + before
                going = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1) & (found.doc[1:] == found.doc[:-1])
                first = np.flatnonzero(np.concatenate([[True], ~going]))
                last = np.append(first[1:], len(at)) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digests[k] for k in row[first].tolist()], pa.binary()),
                     batch.column("key").take(pa.array(found.doc[first] + i)), pa.array(at[first]), pa.array(at[last] - at[first])],
                    ["cid", "key", "at", "more"],
                )

    return texts.mapInArrow(scan, "cid binary, key binary, at long, more long").distinct()


# --- sorting and comparing --------------------------------------------------------------------


def multikey_order(suffixes: np.ndarray) -> np.ndarray:
    """The order of the rows of a byte matrix, by multikey quicksort.

    A segment is split in three by its word at one depth; the middle part, equal in that word, goes
    on one word deeper, so no word of a common prefix is looked at twice.
    """
    n, size = suffixes.shape
    deep = -(-size // 8)
    padded = np.zeros((n, deep * 8), np.uint8)
    padded[:, :size] = suffixes
    words = padded.view(">u8").astype(np.uint64)
    order = np.arange(n)
    segments = [(0, n, 0)]
    while segments:
        low, high, depth = segments.pop()
        if high - low < 2 or depth == deep:
            continue
        rows = order[low:high]
        if high - low <= SMALL:
            tails = padded[rows, 8 * depth :]
            step = tails.shape[1]
            data = tails.tobytes()
            order[low:high] = rows[sorted(range(len(rows)), key=lambda k: data[k * step : (k + 1) * step])]  # noqa: B023
            continue
        word = words[rows, depth]
        sample = np.sort(word[:: max(1, len(word) // 63)])
        pivot = sample[len(sample) // 2]
        less, more = word < pivot, word > pivot
        equal = ~(less | more)
        order[low:high] = np.concatenate([rows[less], rows[equal], rows[more]])
        a, b = low + int(less.sum()), high - int(more.sum())
        segments += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def _bytes_from(data: np.ndarray, offset: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """A row of ``width`` bytes for each offset; beyond ``length`` it is 0."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[offset] if width else np.zeros((len(offset), 0), np.uint8)
    rows[np.arange(width) >= length[:, None]] = 0
    return rows


def bucket_repeats(
    data: np.ndarray, offset: np.ndarray, low: np.ndarray, high: np.ndarray, many: np.ndarray,
    a: int, b: int, rule: Rule, alone: bool,
) -> tuple[np.ndarray, np.ndarray]:
    """For rows of one bucket and range of r: marks (row, r - a), and the rows that stay open.

    ``data[offset]`` starts a row's bytes. Open are the first and the last leading string of a
    bucket that has neighbours: other rows with it may be there.
    """
    n = len(offset)
    size = np.minimum(rule.length, a + rule.length - low)
    suffixes = _bytes_from(data, offset + high - a, size, rule.length)
    order = multikey_order(suffixes)
    suffixes, size, low, high, many = suffixes[order], size[order], low[order], high[order], many[order]
    same = suffixes[1:] == suffixes[:-1]
    common = np.where(same.all(axis=1), rule.length, np.argmin(same, axis=1))
    common = np.minimum(common, np.minimum(size[1:], size[:-1]))
    lead = np.concatenate([[True], common < a + rule.length - b])  # starts a new leading string
    group = np.cumsum(lead) - 1
    opened = np.zeros(n, bool)
    if not alone:
        opened = (group == 0) | (group == group[-1])
    marks = np.zeros((n, b - a + 1), bool)
    step = np.arange(a, b + 1)
    marks |= many[:, None] & (step >= low[:, None]) & (step <= high[:, None])
    some = np.flatnonzero((np.bincount(group)[group] > 1) & ~opened)
    if len(some):
        before = _bytes_from(data[::-1], len(data) - (offset[order][some] + high[some] - a), high[some] - a, b - a)
        breaks = np.concatenate([[rule.length + 1], common])  # common with the row before
        left = np.zeros(len(some), np.uint64)
        lows, highs = low[some], high[some]
        # A row after rows that are left out keeps the least common prefix since the last one in.
        shared = np.minimum.reduceat(breaks[: some[-1] + 1], np.concatenate([[0], some[:-1] + 1]))
        new_group = np.concatenate([[True], group[some][1:] != group[some][:-1]])
        for r in range(a, b + 1):
            if r > a:
                left = left * textscan._BASE + _BYTE[before[:, r - a - 1]]
            run = np.cumsum(new_group | (shared < a + rule.length - r))
            active = np.flatnonzero((lows <= r) & (r <= highs))
            active = active[np.bincount(run[active], minlength=run[-1] + 1)[run[active]] > 1]
            if not len(active):
                continue
            keys = mixed(left[active] ^ mixed(run[active].astype(np.uint64)))
            _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
            marks[some[active[times[inverse] > 1]], r - a] = True
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return marks[back], opened[back]


_ROUND = pa.schema([
    ("cid", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("ctx", pa.binary()), ("low", pa.int32()),
    ("high", pa.int32()), ("many", pa.bool_()), ("a", pa.int32()), ("b", pa.int32()),
])


def _whole(column) -> pa.Array:
    if not isinstance(column, pa.ChunkedArray):
        return column
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.nulls(0, column.type)


def sorted_round(rows: DataFrame, rule: Rule, buckets: int) -> DataFrame:
    """(cid, first, last, ...): ranges of r that are repeats; rows with ``ctx`` stay open."""
    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [batch for batch in batches if batch.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        a, b = (table.column(c).to_numpy() for c in ("a", "b"))
        for pair in np.unique(a * 65_536 + b).tolist():
            part = table.filter(pa.array(a * 65_536 + b == pair)).combine_chunks()
            raw, starts, _ = utf8_of_binary(part.column("ctx"))
            low, high = (part.column(c).to_numpy().astype(np.int64) for c in ("low", "high"))
            many = part.column("many").to_numpy(zero_copy_only=False).astype(bool)
            first_r = pair // 65_536
            marks, opened = bucket_repeats(raw, starts, low, high, many, first_r, pair % 65_536, rule, buckets == 1)
            edge = np.diff(np.pad(marks & ~opened[:, None], ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, begin = np.nonzero(edge == 1)
            _, stop = np.nonzero(edge == -1)
            left = np.flatnonzero(opened)
            for rows, values in (
                (row, {"first": begin + first_r, "last": stop - 1 + first_r}),
                (left, {n: _whole(part.column(n)).take(pa.array(left)) for n in ("ctx", "low", "high", "many", "a", "b")}),
            ):
                if not len(rows):
                    continue
                at = pa.array(rows)
                values["cid"] = _whole(part.column("cid")).take(at)
                columns = [pa.array(values[f.name], f.type) if f.name in values else pa.nulls(len(rows), f.type) for f in _ROUND]
                yield from pa.table(columns, _ROUND).to_batches(1 << 12)

    if buckets == 1:
        dealt = rows.repartition(1)
    else:
        suffix = F.expr(f"substring(ctx, high - a + 1, {rule.length})")
        dealt = rows.repartitionByRange(buckets, "a", suffix, "cid")
    return dealt.mapInArrow(
        bucket, "cid binary, first int, last int, ctx binary, low int, high int, many boolean, a int, b int"
    )


def utf8_of_binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole = _whole(column).cast(pa.large_binary())
    _, offsets, data = whole.buffers()
    bounds = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(data, np.uint8), bounds[:-1].copy(), bounds[1:].copy()


def repeated_windows(contexts: DataFrame, rule: Rule) -> DataFrame:
    """(cid, first, last): ranges of r whose windows are repeats, for each distinct row."""
    rows = contexts.withColumns({"a": F.lit(0), "b": F.lit(rule.most)})
    done = []
    while True:
        n = rows.count()
        if not n:
            break
        found = cut_lineage(sorted_round(rows, rule, -(-n // BUCKET)))
        done.append(found.where("ctx IS NULL").select("cid", "first", "last"))
        middle = F.expr("(a + b) DIV 2").cast("int")
        halves = F.array(
            F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("b").alias("b"))
        )
        rows = (
            found.where("ctx IS NOT NULL").drop("first", "last").withColumn("half", F.explode(halves))
            .withColumns({"a": F.col("half.a"), "b": F.col("half.b")}).drop("half")
            .where("low <= b AND high >= a AND a <= b")
        )
        # Single windows are equal as a whole or not at all.
        single = rows.where("a = b").select(
            "cid", "a", "many", F.md5(F.expr(f"substring(ctx, high - a + 1, {rule.length})")).alias("window")
        )
        times = single.groupBy("a", "window").agg((F.count(F.lit(1)) + F.max(F.col("many").cast("int")) > 1).alias("met"))
        done.append(
            single.join(times.where("met"), ["a", "window"])
            .select("cid", F.col("a").alias("first"), F.col("a").alias("last"))
        )
        rows = rows.where("a < b")
    out = done[0] if done else contexts.select("cid", F.col("low").alias("first"), F.col("high").alias("last"))
    for part in done[1:]:
        out = out.unionByName(part)
    return out


# --- whole results ------------------------------------------------------------------------------


def removed_spans(docs: DataFrame, rule: Rule) -> DataFrame:
    """(key, begin, end): byte ranges to remove from each text, overlapping and in any order."""
    texts = texts_of(docs)
    able = texts.where(F.octet_length("text") >= rule.length)
    bits = live_seeds(able, rule)
    contexts = cut_lineage(context_rows(able, bits, rule))
    repeats = cut_lineage(repeated_windows(contexts, rule))
    places = context_places(able, bits, rule)
    spans = places.join(repeats, "cid").select(
        "key", (F.col("at") - F.col("last")).alias("begin"),
        (F.col("at") + F.col("more") - F.col("first") + rule.length).alias("end"),
    )
    copies = (
        able.select("key", F.octet_length("text").cast("long").alias("n"))
        .groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("end")).where("times > 1")
    )
    return spans.unionByName(copies.select("key", F.lit(0).cast("long").alias("begin"), "end"))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ranges that overlap or touch."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    first = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[first], end[np.append(np.flatnonzero(first)[1:], len(end)) - 1]


def deduplicated(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): what is left of each text, as bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = removed_spans(docs, rule).groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_bytes, n_removed, n_spans = [], [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("spans"), strict=True):
                data = text.as_buffer().to_pybytes()
                n_bytes.append(len(data))
                found = ranges.values if ranges.is_valid else None
                if found is None or not len(found):
                    kept.append(data)
                    n_removed.append(0)
                    n_spans.append(0)
                    continue
                begin, end = merged(*(found.field(k).to_numpy() for k in (0, 1)))
                bounds = zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True)
                kept.append(b"".join(data[s:e] for s, e in bounds))
                n_removed.append(int((end - begin).sum()))
                n_spans.append(len(begin))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.withColumn("key", text_key()).join(spans, "key", "left").select("doc_id", "text", "spans")
    return found.mapInArrow(cut, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def report(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return deduplicated(docs, rule).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
