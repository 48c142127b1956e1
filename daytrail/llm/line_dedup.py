"""Removal of repeated lines by an exact set-similarity join.

A line's set is its tokens: its distinct runs of ``width`` lower-cased words, where a line of fewer
words has one token, all its words. The query takes ``width`` 1, the distinct words themselves; in
longer runs one edited word takes ``width`` tokens away, so far fewer lines are found. Tokens are
ordered by rarity: their occurrences are counted over all texts in ``COUNTERS`` counters that tokens
hash to, and rarer counters come first (ties: by hash). Lines are alike from a Jaccard similarity of
0.8 on. A line of n tokens looks for others under its n - ceil(0.8 n) + 1 first tokens and is found
by no smaller ones under n - ceil(8 n / 9) + 1: lines that are alike share one of them. Pairs that
meet are dropped when their lengths, what can still follow after the last token they meet on, or the
bits in which their parities differ, do not allow 0.8; the others are verified on whole sets.

Lines are ordered by (doc_id, hash of the text, line number). Of equal sets all but the first line
are removed; so is a first line that is alike to any earlier line, whether that one stays or not.

*Hot tokens and groups.* Equal sets count once. A token that only one set has is dropped. When pairs
are many, every set first meets the earliest set of each of its tokens alone; a set that is alike to
it is settled, and only sets that are not meet all earlier ones. So a group of many near copies
costs about as many pairs as it has lines.

Defined cases: lines without words stay, as do null and empty texts; rows with equal ids and texts
are one document and keep the same lines; null ids come first; other columns are untouched.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrail.llm.meeting import bits_between, group_ends, meetings, whole_groups
from daytrail.llm.textscan import Words, mixed, parity_bits, pieces, utf8, windows
from daytrail.session import cut_lineage, discard

#: Words of a token where a caller names no width.
WIDTH = 5
#: Counters of token occurrences; 8 bytes each are sent to the tasks.
COUNTERS = 1 << 17
FILTER_BITS = 1 << 23
#: Parity bits of a set, which tell most pairs that are not alike without their words.
PARITY_BITS = 128
#: So many of the few sets that are not settled by the nearest earlier one.
MORE_BITS = 1024
#: While more pairs than this meet for each key of a set, sets meet one earlier set at a time, so often at most.
PAIRS_PER_KEY, ROUNDS = 4, 3
#: Parts that keys are dealt to, and postings that a task gathers before it sends them there.
BUCKETS, WAITING = 1 << 12, 1 << 20
#: A token is hot from so many occurrences of its counter on, and from so many times the mean.
HOT, HOT_TIMES = 1 << 12, 32
# A token's place in the order and its key: 6 bits of rarity, 42 of hash. Above them, 16 bits number
# the line. What sets have in common, and their numbers, are found on all 64 bits of the hashes.
_HASH, _WORD, _LINES = 42, 48, 1 << 16
_LOW = np.uint64((1 << _WORD) - 1)
# What is sent of a set under one of its keys: the key and, in 16 bits below it, the place.
_MOST = (1 << 64 - _WORD) - 1
_POSTING = np.dtype([("key", np.uint64), ("sid", np.int64), ("bits", np.uint64, PARITY_BITS // 64), ("n", np.int32)])


class Tokens:
    """Tokens of the lines of neighbouring texts: ``hash`` and ``line`` (number of a line with words).

    ``doc`` and ``place`` say which text and which of its lines, from 0, each of these is.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int):
        low, high = int(starts[0]), int(ends.max())
        words = Words(raw, starts, ends)
        feeds = np.flatnonzero(raw[low:high] == 10) + low
        local = np.searchsorted(feeds, words.start) - np.searchsorted(feeds, starts)[words.doc]
        change = np.ones(len(words.start), bool)
        change[1:] = (np.diff(words.doc) != 0) | (np.diff(local) != 0)
        first = np.flatnonzero(change)
        self.doc, self.place = words.doc[first], local[first]
        line = np.cumsum(change) - 1
        size = np.diff(np.append(first, len(line)))
        runs = windows(words.hash, width)
        inside = np.flatnonzero(line[: len(runs)] == line[width - 1 :]) if len(runs) else np.zeros(0, np.int64)
        hashes, lines = [runs[inside]], [line[inside]]
        for few in range(1, width):
            short = np.flatnonzero(size == few)
            hashes.append(windows(words.hash, few)[first[short]] if len(short) else np.zeros(0, np.uint64))
            lines.append(short)
        self.hash, self.line = np.concatenate(hashes), np.concatenate(lines)

    def counter(self) -> np.ndarray:
        return (self.hash & np.uint64(COUNTERS - 1)).astype(np.int64)


def count_tokens(docs: DataFrame, width: int) -> np.ndarray:
    """Occurrences by counter, over all texts."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            raw, starts, ends = utf8(batch.column("text"))
            for i, j in pieces(starts, ends):
                if ends[i:j].max() > starts[i]:
                    counts += np.bincount(Tokens(raw, starts[i:j], ends[i:j], width).counter(), minlength=COUNTERS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["counter", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(scan, "counter long, n long")
    sums = cut_lineage(found.groupBy("counter").agg(F.sum("n").alias("n")))
    table = sums.toArrow()  # COUNTERS rows at most
    discard(sums)
    counts = np.zeros(COUNTERS, np.int64)
    counts[table["counter"].to_numpy()] = table["n"].to_numpy()
    return counts


def rarity(counts: np.ndarray) -> np.ndarray:
    """Counts as classes 0 to 63, two to each doubling; the sorting weight of a counter."""
    return np.minimum(63, np.ceil(2 * np.log2(np.maximum(counts, 1))).astype(np.int64)).astype(np.uint64)


def hot_class(counts: np.ndarray) -> int:
    """The class (see :func:`rarity`) from which on tokens are hot."""
    return int(np.ceil(2 * np.log2(max(HOT, HOT_TIMES * counts.mean()))))


class LineSets:
    """The sets of the lines of neighbouring texts, found together.

    ``doc`` and ``line`` name each line with words, ``number`` its set, ``n`` its size; ``first``
    bounds its tokens in ``tokens`` (keys) and ``hashes`` (whole), which are in order of rarity.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, width: int):
        found = Tokens(raw, starts, ends, width)
        self.doc, self.line = found.doc, found.place
        many = len(self.doc)
        token = (weights[found.counter()] << np.uint64(_HASH)) | (found.hash >> np.uint64(64 - _HASH))
        tokens, hashes, owners = [], [], []
        for some in range(0, many, _LINES):
            mine = slice(None)
            if many > _LINES:
                mine = np.flatnonzero((found.line >= some) & (found.line < some + _LINES))
            packed, whole = ((found.line[mine] - some).astype(np.uint64) << np.uint64(_WORD)) | token[mine], found.hash[mine]
            order = np.argsort(packed)
            same = packed[order[1:]] == packed[order[:-1]]
            if (same & (whole[order[1:]] != whole[order[:-1]])).any():  # unlike tokens of a line with one key
                order = np.lexsort((whole, packed))
            packed, whole = packed[order], whole[order]
            new = np.append(True, (packed[1:] != packed[:-1]) | (whole[1:] != whole[:-1]))
            packed = packed[new]
            tokens.append(packed & _LOW)
            hashes.append(whole[new])
            owners.append((packed >> np.uint64(_WORD)).astype(np.int64) + some)
        self.tokens = np.concatenate([np.zeros(0, np.uint64), *tokens])
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *hashes])
        owner = np.concatenate([np.zeros(0, np.int64), *owners])
        self.first = np.searchsorted(owner, np.arange(many + 1))
        self.n = np.diff(self.first)
        sums = np.add.reduceat(mixed(self.hashes), self.first[:-1]) if many else np.zeros(0, np.uint64)
        self.number = mixed(sums + self.n.astype(np.uint64)).view(np.int64)

    def parities(self) -> np.ndarray:
        return parity_bits(self.hashes, self.first, PARITY_BITS)

    def prefixes(self, chosen: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the line, place, key) of the first n - ceil(0.8 n) + 1 tokens of each.

        A token of class ``hot`` is no key, but it and each one after it up to the next place beyond are;
        their place is that of the second less 1. Lines that are alike have two tokens in common at least,
        and the second of these lies one place further at most.
        """
        size = self.n[chosen] // 5 + 1
        owner, size = np.repeat(chosen, size), np.repeat(size, size)
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        token = self.tokens[self.first[owner] + place]
        common = token >> np.uint64(_HASH) >= np.uint64(hot)
        rare, common = np.flatnonzero(~common), np.flatnonzero(common)
        many = size[common] - place[common]
        one = np.repeat(common, many)
        second = place[one] + 1 + np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many)
        both = mixed(token[one] * np.uint64(0x9E3779B97F4A7C15) + self.tokens[self.first[owner[one]] + second]) & _LOW
        return (
            np.concatenate([owner[rare], owner[one]]),
            np.concatenate([place[rare], second - 1]),
            np.concatenate([token[rare], both]),
        )


def line_sets(column: pa.Array, weights: np.ndarray, width: int) -> Iterator[tuple[int, LineSets]]:
    """The sets of a column's lines, with the number of the first text of each piece."""
    raw, starts, ends = utf8(column)
    for i, j in pieces(starts, ends):
        if ends[i:j].max() > starts[i]:
            yield i, LineSets(raw, starts[i:j], ends[i:j], weights, width)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("t"), text.alias("text"))


def index_lines(docs: DataFrame, weights: np.ndarray, hot: int, width: int) -> DataFrame:
    """(bucket, doc_id, t, places, sids, postings): documents, and, with nulls, sets under their keys.

    A document's lines with words have ``places`` and set numbers. ``postings``: rows of ``_POSTING``
    of one bucket of keys.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["bucket", "doc_id", "t", "places", "sids", "postings"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def dealt(ids: pa.DataType) -> pa.RecordBatch:
            rows = np.concatenate([np.zeros(0, _POSTING), *waiting])
            waiting.clear()
            bucket = (rows["key"] >> np.uint64(64 - _WORD)) & np.uint64(BUCKETS - 1)
            rows = rows[np.argsort(bucket, kind="stable")]
            sizes = np.bincount(bucket.astype(np.int64), minlength=BUCKETS)
            used = np.flatnonzero(sizes)
            bounds = np.append(0, np.cumsum(sizes[used])) * _POSTING.itemsize
            parts = pa.Array.from_buffers(
                pa.binary(), len(used), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())]
            )
            nothing = [pa.nulls(len(used), x) for x in (ids, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *nothing, parts], names)

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("t")
            known = np.zeros(0, np.int64)
            for base, sets in line_sets(batch.column("text"), weights, width):
                if not len(sets.n):
                    continue
                rows, first = np.unique(sets.doc, return_index=True)
                bounds, rows = pa.array(np.append(first, len(sets.n)).astype(np.int32)), rows + base
                own = texts.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((own.to_numpy(zero_copy_only=False) & (BUCKETS - 1)).astype(np.int32)), ids.take(pa.array(rows)), own,
                        pa.ListArray.from_arrays(bounds, pa.array(sets.line.astype(np.int32))),
                        pa.ListArray.from_arrays(bounds, pa.array(sets.number)), pa.nulls(len(rows), pa.binary()),
                    ],
                    names,
                )
                _, chosen = np.unique(sets.number, return_index=True)
                # Up to three tokens only equal sets are alike.
                chosen = np.sort(chosen[(sets.n[chosen] > 3) & ~np.isin(sets.number[chosen], known)])
                known = np.concatenate([known, sets.number[chosen]])
                owner, place, key = sets.prefixes(chosen, hot)
                postings = np.zeros(len(owner), _POSTING)
                postings["key"] = (key << np.uint64(64 - _WORD)) | np.minimum(place, _MOST).astype(np.uint64)
                postings["sid"], postings["n"], postings["bits"] = sets.number[owner], sets.n[owner], sets.parities()[owner]
                waiting.append(postings)
                if sum(map(len, waiting)) > WAITING:
                    yield dealt(ids.type)
            if waiting and sum(map(len, waiting)) > WAITING // 2:
                yield dealt(ids.type)
            left = ids.type
        if waiting:
            yield dealt(left)

    return _keyed(docs).mapInArrow(
        scan, f"bucket int, doc_id {kind}, t long, places array<int>, sids array<long>, postings binary"
    )


def _possible(n: np.ndarray, place: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether sets i and j that meet on a token can be alike; in how many bits of their parities they differ."""
    both, apart = n[i] + n[j], bits_between(bits, i, j)
    # Before the token and from it on at most the shorter part is common.
    most = np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j])
    far = np.maximum(place[i], place[j]) >= _MOST  # places are known so far
    return (9 * apart <= both) & ((18 * most >= 8 * both) | far), apart


def _are_found(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Those that no smaller sets find under a key."""
    return np.flatnonzero(place < n // 9 + 1)


def close_sets(index: DataFrame) -> DataFrame:
    """The documents of ``index`` (doc_id, t, places, sids) and, with nulls, the sets that meet one they can be alike to.

    These have (key, sid, n, place, bits), a row for each key on which they do.
    """
    kind = index.schema["doc_id"].dataType.simpleString()
    documents = ["doc_id", "t", "places", "sids"]
    found = {"key": pa.int64(), "sid": pa.int64(), "n": pa.int32(), "place": pa.int32(), "bits": pa.list_(pa.int64())}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            for some in table.filter(table["sids"].is_valid()).select(documents).to_batches():
                nothing = [pa.nulls(some.num_rows, x) for x in found.values()]
                yield pa.RecordBatch.from_arrays([*some.columns, *nothing], [*documents, *found])
            rows = _postings(table["postings"])
            key = rows["key"] >> np.uint64(64 - _WORD)
            order = np.argsort(key)
            shared = key[order[1:]] == key[order[:-1]]
            order = order[np.append(False, shared) | np.append(shared, False)] if len(order) else order  # one row alone tells nothing
            rows, key = rows[order], key[order]
            order = np.lexsort((rows["sid"], rows["n"], key))
            rows, key = rows[order], key[order]
            once = np.append(np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (rows["sid"][1:] != rows["sid"][:-1]))
            rows, key = rows[once], key[once]
            n, place = rows["n"].astype(np.int64), (rows["key"] & np.uint64(_MOST)).astype(np.int64)
            bits, met = np.ascontiguousarray(rows["bits"]), np.zeros(len(rows), bool)
            for i, j in meetings(group_ends(key), _are_found(n, place), lambda i, j: 10 * n[i] >= 8 * n[j]):
                new = ~(met[i] & met[j])
                i, j = i[new], j[new]
                can, _ = _possible(n, place, bits, i, j)
                met[i[can]] = met[j[can]] = True
            at = np.flatnonzero(met)
            ids = table.schema.field("doc_id").type
            nothing = [pa.nulls(len(at), x) for x in (ids, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))]
            own = [pa.array(x) for x in (key[at].view(np.int64), rows["sid"][at], rows["n"][at], place[at].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*nothing, *own, _lists(bits[at])], [*documents, *found])

    return index.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        compare,
        f"doc_id {kind}, t long, places array<int>, sids array<long>, key long, sid long, n int, place int, bits array<long>",
    )


def _lists(words: np.ndarray) -> pa.Array:
    many, width = words.shape
    return pa.ListArray.from_arrays(np.arange(many + 1, dtype=np.int32) * width, pa.array(words.view(np.int64).ravel()))


def _postings(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of all parts of a column."""
    rows = [np.zeros(0, _POSTING)]
    for part in column.drop_null().chunks:
        if len(part):
            _, offsets, data = part.buffers()
            bounds = np.frombuffer(offsets, np.int32)[[part.offset, part.offset + len(part)]]
            rows.append(np.frombuffer(data, np.uint8)[bounds[0] : bounds[1]].view(_POSTING))
    return np.concatenate(rows)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, sid) of neighbouring keys, and an iterator over the pairs that meet there.

    Each turn has (row of the later set, row of the earlier one, share), an array naming a row once: the share of
    bits of both sets' size in which they differ. Pairs not beyond what ``members`` has ``past`` are left out.
    """
    def pairs(rank, sid, n, place, bits, past, past_sid, ends):
        for i, j in meetings(ends, _are_found(n, place), lambda i, j: 10 * n[i] >= 8 * n[j]):
            later = np.where(rank[i] > rank[j], i, j)
            some = past[later] < np.inf
            i, j = i[some], j[some]
            may, apart = _possible(n, place, bits, i, j)
            i, j, share = i[may], j[may], apart[may] / (n[i[may]] + n[j[may]])
            for x, y in ((i, j), (j, i)):
                new = (rank[x] > rank[y]) & ((share > past[x]) | ((share == past[x]) & (sid[y] > past_sid[x])))
                yield x[new], y[new], share[new]

    for table in whole_groups(batches, "key"):
        key, sid, n, place, rank, past, past_sid = (
            table[c].to_numpy() for c in ("key", "sid", "n", "place", "rank", "past", "past_sid")
        )
        bits = table["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(key), -1)
        yield key, sid, pairs(rank, sid, n.astype(np.int64), place.astype(np.int64), bits, past, past_sid, group_ends(key))


def nearest_earlier(members: DataFrame) -> DataFrame:
    """(key, later, earlier, share, many): for each key and set the earlier set nearest by parity bits, of how many.

    ``members``: (key, sid, n, place, bits) as :func:`close_sets` gives them, ``rank``, lower for earlier
    ones, and (past, past_sid): the share and the number of the last set that was compared, infinite if no more are wanted.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sid, pairs in _met(batches):
            best, least, many = np.zeros(len(sid), np.int64), np.full(len(sid), np.inf), np.zeros(len(sid), np.int64)
            for x, y, share in pairs:
                many[x] += 1
                less = (share < least[x]) | ((share == least[x]) & (sid[y] < best[x]))
                least[x[less]], best[x[less]] = share[less], sid[y[less]]
            found = np.flatnonzero(many)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[found]) for x in (key, sid, best, least, many)], ["key", "later", "earlier", "share", "many"]
            )

    return _by_key(members).mapInArrow(compare, "key long, later long, earlier long, share double, many long")


def every_earlier(members: DataFrame) -> DataFrame:
    """(later, earlier): all earlier sets that sets meet, of ``members`` as in :func:`nearest_earlier`."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sid, pairs in _met(batches):
            for x, y, _ in pairs:
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(sid[x]), pa.array(sid[y])], ["later", "earlier"])

    return _by_key(members).mapInArrow(compare, "later long, earlier long").distinct()


def _by_key(members: DataFrame) -> DataFrame:
    return members.repartition("key").sortWithinPartitions("key", "n", "sid")


def _filter(keys: DataFrame) -> np.ndarray:
    """``FILTER_BITS`` bits, set for the values of the first column."""
    at = F.pmod(F.col(keys.columns[0]), F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, CAST(pmod({keys.columns[0]}, {FILTER_BITS}) % 64 AS INT))")
    rows = keys.groupBy(F.floor(at / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    filled = np.zeros(FILTER_BITS // 64, np.int64)  # as many rows at most
    for row in rows:
        filled[row["word"]] = row["bits"]
    return filled


def _has(filled: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & (FILTER_BITS - 1)
    return ((filled[at >> 6] >> (at & 63)) & 1).astype(bool)


def wanted_sets(docs: DataFrame, weights: np.ndarray, width: int, wanted: DataFrame) -> DataFrame:
    """(sid, tokens) of the sets in ``wanted`` (sid, t), each once; ``t``: the hash of a text that has the set."""
    texts, numbers = _filter(wanted.select("t")), _filter(wanted.select("sid"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = _has(texts, batch.column("t").to_numpy(zero_copy_only=False))
            for _, sets in line_sets(batch.column("text").filter(pa.array(some)), weights, width):
                hit = np.flatnonzero(_has(numbers, sets.number))
                hit = hit[np.unique(sets.number[hit], return_index=True)[1]]
                tokens = [np.sort(sets.hashes[sets.first[k] : sets.first[k + 1]]).tobytes() for k in hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets.number[hit]), pa.array(tokens, pa.binary())], ["sid", "tokens"]
                )

    found = _keyed(docs).select("t", "text").mapInArrow(scan, "sid long, tokens binary")
    return found.join(wanted, "sid", "left_semi").dropDuplicates(["sid"])


def more_bits(sets: DataFrame) -> DataFrame:
    """(sid, bits): ``MORE_BITS`` parity bits of the sets."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("tokens")]
            first = np.append(0, np.cumsum([len(x) for x in hashes])).astype(np.int64)
            bits = parity_bits(np.concatenate([np.zeros(0, np.uint64), *hashes]), first, MORE_BITS)
            yield pa.RecordBatch.from_arrays([batch.column("sid"), _lists(bits)], ["sid", "bits"])

    return sets.select("sid", "tokens").mapInArrow(count, "sid long, bits array<long>")


def true_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have a Jaccard similarity of 0.8 or more."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = np.zeros(len(left), bool)
            for k in range(len(left)):
                x, y = (np.frombuffer(side[k].as_buffer(), np.uint64) for side in (left, right))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 10 * common >= 8 * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = (
        pairs.join(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("left")), "a")
        .join(sets.select(F.col("sid").alias("b"), F.col("tokens").alias("right")), "b")
        .select("a", "b", "left", "right")
    )
    return both.mapInArrow(compare, "a long, b long")


def alike_to_earlier(docs: DataFrame, weights: np.ndarray, width: int, close: DataFrame, classes: DataFrame) -> DataFrame:
    """(sid) of the sets of ``close`` (see :func:`close_sets`) whose first line is alike to an earlier one."""
    named = cut_lineage(classes.join(close.select("sid").distinct(), "sid", "left_semi"))
    # Parts of a sorted table are numbered in its order.
    ranks = cut_lineage(named.orderBy("first").select("sid", F.monotonically_increasing_id().alias("rank")))
    members = cut_lineage(close.join(ranks, "sid"))
    sets = cut_lineage(wanted_sets(docs, weights, width, named.select("sid", F.col("first.t").alias("t"))))
    discard(named, ranks)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """(later) of the true ones among pairs (later, earlier)."""
        pairs = pairs.select(F.col("later").alias("a"), F.col("earlier").alias("b"))
        return cut_lineage(true_pairs(pairs, sets).select(F.col("a").alias("later")).distinct())

    settled = []
    members = members.withColumns({"past": F.lit(-1.0), "past_sid": F.lit(0).cast("long")})
    for turn in range(ROUNDS):
        near = cut_lineage(nearest_earlier(members))
        meets, pairs = near.agg(F.count(F.lit(1)), F.sum("many")).first()
        if not meets or turn and pairs <= PAIRS_PER_KEY * meets:
            break
        best = cut_lineage(near.groupBy("later").agg(F.min(F.struct("share", "earlier")).alias("best")))
        settled.append(confirmed(best.select("later", "best.earlier")))
        # A pair whose later set is settled tells nothing more, nor does a key on which only the best met.
        still = cut_lineage(best.join(settled[-1], "later", "left_anti"))
        more = near.join(still, "later").where("many > 1 OR earlier <> best.earlier").select("key").distinct()
        past = still.select(F.col("later").alias("sid"), F.col("best.share").alias("share"), F.col("best.earlier").alias("earlier"))
        rows = members.join(more, "key", "left_semi").drop("past", "past_sid").join(past, "sid", "left")
        if not turn:
            # From now on with more bits, which see other shares.
            rows = rows.drop("bits").join(more_bits(sets), "sid").withColumns(
                {"share": F.when(F.col("share").isNotNull(), F.lit(-1.0)), "earlier": F.lit(0).cast("long")}
            )
        rows = rows.withColumns(
            {"past": F.coalesce("share", F.lit(float("inf"))), "past_sid": F.coalesce("earlier", F.lit(0).cast("long"))}
        )
        every, members = members, cut_lineage(rows.select(*members.columns))
        discard(every, near, best, still)
    settled.append(confirmed(cut_lineage(every_earlier(members))))
    discard(members, sets)
    return functools.reduce(DataFrame.union, settled).withColumnRenamed("later", "sid")


def removed_lines(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, t, n_lines, removed): numbers (from 0) of the removed lines of each document.

    Only documents with a line that has words have a row; ``n_lines`` counts those lines.
    """
    counts = count_tokens(docs, width)
    weights = rarity(counts)
    met = cut_lineage(close_sets(index_lines(docs, weights, hot_class(counts), width)))
    documents = met.where("sids IS NOT NULL")
    lines = documents.select("doc_id", "t", F.inline(F.arrays_zip(F.col("places").alias("line"), F.col("sids").alias("sid"))))
    classes = cut_lineage(
        lines.repartition("sid").groupBy("sid")  # most have one line
        .agg(F.min(F.struct("doc_id", "t", "line")).alias("first"), F.count(F.lit(1)).alias("m"))
    )
    close = met.where("sids IS NULL").select("key", "sid", "n", "place", "bits")
    gone = alike_to_earlier(docs, weights, width, close, classes.select("sid", "first"))
    decided = (
        classes.join(gone.withColumn("gone", F.lit(True)), "sid", "left")
        .where("m > 1 OR gone").select("sid", "first", "gone")
    )
    out = lines.join(decided, "sid").where(F.coalesce("gone", F.lit(False)) | (F.struct("doc_id", "t", "line") != F.col("first")))
    sizes = documents.select("doc_id", "t", F.size("sids").cast("long").alias("n_lines"), F.lit(None).cast("int").alias("line"))
    every = sizes.union(out.select("doc_id", "t", F.lit(None).cast("long"), "line"))
    return every.groupBy("doc_id", "t").agg(
        F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_set("line")).alias("removed")  # of one document
    )


def _with_removed(docs: DataFrame, columns: list[str], width: int) -> DataFrame:
    removed = removed_lines(docs, width).withColumnRenamed("doc_id", "id").withColumnRenamed("t", "u")
    rows = _keyed(docs).select("doc_id", "t", *columns)
    return rows.join(removed, rows["doc_id"].eqNullSafe(removed["id"]) & (rows["t"] == removed["u"]), "left")


def line_report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed), a row for each row of ``docs``.

    ``n_lines``: lines with words; ``removed``: their numbers in the text, from 0.
    """
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return _with_removed(docs, [], width).select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"),
    )


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text), a row for each row of ``docs``; the text without its removed lines."""
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return _with_removed(docs, ["text"], width).select("doc_id", text.alias("text"))
