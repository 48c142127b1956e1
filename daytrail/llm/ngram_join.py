"""Jaccard join over word n-grams, size-aware, and the groups its links make.

A document's set holds the hashes of its distinct shingles of ``width`` words. Two sets link when
``100 * common >= percent * union``; sets whose sizes differ by more never do. Both numbers are a
:class:`Rule`, from which all depths below follow: op4 takes 3 words and 90, the pipeline 5 and 80.

*Order.* Shingles are ordered by how often they occur, rare ones first, then by hash. Any fixed
order gives right results; this one keeps common passages out of the keys. Counts are gathered
over all documents (each batch reports the shingles that it saw more than once) and the
``HEAVY`` most common ones are ordered last.

*Light and heavy sets.* A set of n may lack s = n (100 - percent) // 100 of its shingles. Small sets
give as keys all pairs among their s + 2 first shingles: linked sets share a pair, and a pair is
rare. Large sets scan inverted lists of their s + m first shingles; in the lists are the sets of
their size and smaller ones, under their n (100 - percent) // (100 + percent) + m first shingles,
since those may lack fewer. Linked sets meet on m lists, with m = s // 8 + 1 of the smaller set, so sets
that have fewer lists with others are out.
The size between small and large is the one at which both ways cost least, from measured sizes and
list lengths (:func:`boundary`).

*Keys to links.* Equal sets are one set with one number, so copies cost nothing. A key that only
one set has is dropped. The task that has a key compares its sets in place by their sizes and parity
bits; those that have one to link to meet again in further rounds, the rest is done. In a round every
set is compared exactly with the nearest by those bits alone, and what links is joined into groups.
Keys whose sets are all in one group are done, since they can tell nothing more about groups; when
pairs are few, all that are left between sets of different groups are compared. No pair within a group
is compared, and none between groups is left out: the groups are those of the complete join.

*Crowded keys.* Pairs of so many sets are too many even to be looked at. Near copies just below the threshold share nearly all their rare shingles. A key of
many sets is therefore split by what they differ in from its leader L: with A and B what x and y differ
in from L, x and y differ in a + b - 2 |A & B|. Where x or y does not link with L, a + b alone is more
than links allow, so A and B have shingles in common, as many as :func:`differences` derives from sizes; where
both link with L, they are one group. Shingles that only one set of L differs in are not in common: most sets
are out when these go, as edits are rarely the same. The others meet under up to three of their common shingles
at once (:func:`difference_keys`). What is still crowded is split again, by other leaders.

Every comparison uses whole sets. Set numbers are 64-bit hashes.

Defined cases: a text without words, or null, has an empty set and is linked with nothing; with
fewer words than a shingle its whole sequence is the one shingle; rows with the same or no id are rows of
their own; a group whose ids are all null has a null ``component_id``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.llm.components import components
from daytrail.llm.columns import bits_apart
from daytrail.llm.meeting import bits_between, group_ends, meetings, whole_groups
from daytrail.llm.textscan import Words, mixed, parity_bits, pieces, utf8, windows
from daytrail.session import cut_lineage, discard

#: Most common shingles that are ordered by count; 16 bytes each are sent to the tasks.
HEAVY = 1 << 16
#: Size classes (by how many shingles a set may lack) told apart by the cost model; the last is open.
CLASSES = 64
#: Bits of the filter that keeps sets which nothing asks for out of the comparison.
FILTER_BITS = 1 << 23
#: Parity bits of a set, which tell most pairs that do not link without their shingles; more where sets may lack more.
PARITY_BITS, MOST_BITS = 512, 1 << 14
#: Rounds end when fewer pairs than this are left for each key of a set.
PAIRS_PER_KEY = 4
#: A further round pays while one set of this many gets a link.
ROUND_PAYS = 20
#: A key with more pairs than this for each of its sets is split; a task compares so many by parity bits in place.
CROWD = 2048
#: Keys that a crowd's sets may have each, on average, for meeting under two or three shingles at once.
KEYS = 32
#: How often crowded keys are split; keys that are crowded after that are joined as they are.
SPLITS = 3


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the Jaccard similarity in percent from which sets link."""

    width: int = 3
    percent: int = 90

    def slack(self, n: int) -> int:
        """How many of its shingles a set of n may lack."""
        return n * (100 - self.percent) // 100

    def alone(self, n: int) -> bool:
        """Whether a set of n links with equal sets only: one shingle more is too many."""
        return n * (100 - self.percent) < self.percent

    @property
    def bits(self) -> int:
        """Parity bits of a set; those that may differ must be few among them."""
        return PARITY_BITS << (max(0, (100 - self.percent - 1) // 10)).bit_length()

    def bits_of(self, n: int) -> int:
        """And of a set of n, which may differ in more."""
        return min(MOST_BITS, max(self.bits, 1 << (n * (100 - self.percent) // 40).bit_length()))

    def sizes_fit(self, n: Column, m: Column) -> Column:
        return F.least(n, m) * 100 >= F.greatest(n, m) * self.percent

    def lists(self, n: Column) -> Column:
        """On how many lists a set of n meets those it links with."""
        return F.floor(n * (100 - self.percent) / 800) + 1

    def in_list(self, n: Column, pos: Column) -> Column:
        """Whether a key is one under which others of no smaller size find the set."""
        return (pos < 0) | (pos < F.floor(n * (100 - self.percent) / (100 + self.percent)) + self.lists(n))

    def enough(self, common: Column, both: Column) -> Column:
        """Whether sets of ``both`` shingles together link if so many are common."""
        return (100 + self.percent) * common >= self.percent * both


#: The contract of op4.
OP4 = Rule()


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, starts, ends = utf8(column)
    for i, j in pieces(starts, ends):
        if ends[i:j].max() == starts[i]:
            yield from (np.zeros(0, np.uint64) for _ in range(i, j))
            continue
        words = Words(raw, starts[i:j], ends[i:j])
        grams = windows(words.hash, width)
        first = words.first.tolist()
        for k in range(j - i):
            a, b = first[k], first[k + 1]
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            else:
                yield windows(words.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def set_number(tokens: np.ndarray) -> int:
    """One number for equal sets."""
    total = np.add.reduce(mixed(tokens ^ np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)
    return int(mixed(np.array([total + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def survey(docs: DataFrame, rule: Rule) -> DataFrame:
    """One pass over the texts: (kind, doc_id, a, n, bits).

    kind 0: a document, a = its set's number (null if empty), n = its size, with parity bits; kind 1: a shingle
    seen n times in a batch; kind 2: one row a batch with the sums the cost model needs.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), rule.width))
            numbers = [set_number(s) if len(s) else None for s in sets]
            one = {number: s for number, s in zip(numbers, sets, strict=True) if number is not None}
            tokens, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *one.values()]), return_counts=True)
            often = counts > 2
            sizes = [len(s) for s in sets]
            for i in range(0, len(sets), 256):
                own = slice(i, i + 256)
                yield _survey_rows(0, batch.column("doc_id")[own], numbers[own], sizes[own], _set_bits(sets[own], [rule.bits_of(n) for n in sizes[own]]))
            for kind_no, a, n in (
                (1, tokens[often].view(np.int64), counts[often]),
                (2, [len(one)], [int((counts[~often] ** 2).sum() * 1000 // max(1, counts[~often].sum()))]),
            ):
                nulls = pa.nulls(len(a), batch.schema.field("doc_id").type)
                yield _survey_rows(kind_no, nulls, a, n, pa.nulls(len(a), pa.list_(pa.int64())))

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        scan, f"kind int, doc_id {kind}, a long, n long, bits array<long>"
    )


def _survey_rows(kind_no: int, ids: pa.Array, a, n, bits: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(ids), kind_no, np.int32)), ids, pa.array(a, pa.int64()), pa.array(n, pa.int64()), bits],
        ["kind", "doc_id", "a", "n", "bits"],
    )


def _set_bits(sets: list[np.ndarray], many: list[int]) -> pa.Array:
    """Parity bits of each set, ``many`` of them; null for an empty one."""
    out: list = [None] * len(sets)
    for width in set(many):
        used = [k for k, s in enumerate(sets) if len(s) and many[k] == width]
        first = np.append(0, np.cumsum([len(sets[k]) for k in used])).astype(np.int64)
        words = parity_bits(np.concatenate([np.zeros(0, np.uint64), *(sets[k] for k in used)]), first, width)
        for k, row in zip(used, words.view(np.int64), strict=True):
            out[k] = row
    return pa.array(out, pa.list_(pa.int64()))


class Parities:
    """Parity bits of the rows of a list column, of which some may have more than others."""

    def __init__(self, column: pa.Array):
        words = column.flatten().to_numpy().view(np.uint64)
        self.width = np.diff(column.offsets.to_numpy()).astype(np.int64)
        start = np.cumsum(self.width) - self.width
        self.words, self.place = {}, {}
        wider, rows = None, np.zeros(0, np.int64)
        for width in sorted(set(self.width.tolist()), reverse=True):
            own = np.flatnonzero(self.width == width)
            mine = words[start[own][:, None] + np.arange(width)]
            if wider is not None:
                # Bit b of fewer ones is the parity of all those that are b modulo their number.
                wider = np.bitwise_xor.reduce(wider.reshape(len(rows), -1, width), axis=1)
                mine = np.concatenate([wider, mine])
            wider, rows = mine, np.concatenate([rows, own])
            self.words[width] = wider
            self.place[width] = np.zeros(len(self.width), np.int64)
            self.place[width][rows] = np.arange(len(rows))

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits rows differ, by as many as the one with fewer has."""
        out, width = np.zeros(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for w in self.words:
            at = np.flatnonzero(width == w)
            if len(at):
                out[at] = bits_between(self.words[w], self.place[w][i[at]], self.place[w][j[at]])
        return out


def boundary(classes: dict[int, int], list_length: float, percent: int = 90) -> int:
    """The slack up to which sets are small, -1 for none.

    A small set of class d costs (d + 2)(d + 1) / 2 keys; a large one d + d // 8 + 1 keys and as
    many scans of lists of ``list_length``. Sets that are smaller but can link with large ones pay for
    both.
    """
    step = 100 / (100 - percent)  # sizes in a class

    def cost(limit: int) -> float:
        total = 0.0
        for d, sets in classes.items():
            if d <= limit:
                total += sets * (d + 2) * (d + 1) / 2
            listed = min(1.0, max(0.0, (step * (d + 1) - (step - 1) * (limit + 1)) / step))
            total += sets * listed * (d + d // 8 + 1) * (1 + list_length)
        return total

    return min(range(-1, CLASSES - 1), key=cost)


def set_keys(docs: DataFrame, heavy: np.ndarray, counts: np.ndarray, limit: int, rule: Rule) -> DataFrame:
    """(key, sid, n, pos): the keys of every document's set.

    ``heavy`` is sorted, ``counts`` goes with it. Pair keys have pos -1.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: set[int] = set()
            keys, numbers, sizes, places = [], [], [], []

            def flush() -> pa.RecordBatch:
                lengths = [len(k) for k in keys]
                out = pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)),
                        pa.array(np.repeat(np.array(numbers, np.int64), lengths)),
                        pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                        pa.array(np.concatenate([np.zeros(0, np.int32), *places]).astype(np.int32)),
                    ],
                    ["key", "sid", "n", "pos"],
                )
                for x in (keys, numbers, sizes, places):
                    x.clear()
                return out

            waiting = 0
            for tokens in shingle_sets(batch.column("text"), rule.width):
                n = len(tokens)
                if rule.alone(n):
                    continue
                number = set_number(tokens)
                if number in known:
                    continue
                known.add(number)
                slack = rule.slack(n)
                listed = slack + slack // 8 + 1
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
                    weight = np.where(heavy[at] == tokens, counts[at], 0)
                    order = tokens[np.argsort(weight, kind="stable")[: listed + 1]]
                else:
                    order = tokens[: listed + 1]
                if slack <= limit:
                    i, j = np.triu_indices(min(slack + 2, n), 1)
                    low, high = np.minimum(order[i], order[j]), np.maximum(order[i], order[j])
                    keys.append(mixed(low * np.uint64(0x9E3779B97F4A7C15) + high))
                    numbers.append(number), sizes.append(n), places.append(np.full(len(i), -1, np.int32))
                    waiting += len(i)
                # A set that some large one can link to is in the lists too.
                if n * (100 - rule.percent) >= rule.percent * (limit + 1):
                    keys.append(mixed(order[:listed] ^ np.uint64(0xA24BAED4963EE407)))
                    numbers.append(number), sizes.append(n), places.append(np.arange(listed, dtype=np.int32))
                    waiting += listed
                if waiting > 200_000:
                    yield flush()
                    waiting = 0
            yield flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        scan, "key long, sid long, n int, pos int"
    )


def wanted_sets(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(sid, tokens, n, bits) of the sets in ``wanted`` (sid, rep), each once.

    ``rep`` is the smallest id that has the set. A filter of ``FILTER_BITS`` bits over these ids,
    gathered as at most ``FILTER_BITS / 64`` numbers, spares most other texts the way; the join
    keeps the exact ones.
    """
    def bit(key: str):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(FILTER_BITS))

    words = (
        wanted.groupBy(F.floor(bit("rep") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(CAST(rep AS STRING)), {FILTER_BITS}) % 64 AS INT))")).alias("bits"))
        .collect()
    )
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words:
        filled[row["word"]] = row["bits"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("bit").to_numpy(zero_copy_only=False)
            hit = ((filled[bits >> 6] >> (bits & 63)) & 1).astype(bool)
            sets = [s for s in shingle_sets(batch.column("text").filter(pa.array(hit)), rule.width) if len(s)]
            for i in range(0, len(sets), 256):
                some = sets[i : i + 256]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([set_number(s) for s in some], pa.int64()), pa.array([s.tobytes() for s in some], pa.binary()),
                        pa.array([len(s) for s in some], pa.int32()), _set_bits(some, [rule.bits] * len(some)),
                    ],
                    ["sid", "tokens", "n", "bits"],
                )

    rows = docs.select(bit("doc_id").cast("long").alias("bit"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(scan, "sid long, tokens binary, n int, bits array<long>")
    return found.join(wanted, "sid", "left_semi").dropDuplicates(["sid"])


def true_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = np.zeros(len(left), bool)
            for k in range(len(left)):
                x, y = (np.frombuffer(side[k].as_buffer(), np.uint64) for side in (left, right))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = (
        pairs.join(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("left")), "a")
        .join(sets.select(F.col("sid").alias("b"), F.col("tokens").alias("right")), "b")
        .select("a", "b", "left", "right")
    )
    return both.mapInArrow(compare, "a long, b long")


def possible(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that can link by their parity bits: sets differ in as many shingles as bits at least."""
    for c in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")), c)
    can = (100 + rule.percent) * bits_apart("bits_a", "bits_b") <= (100 - rule.percent) * (F.col("n_a") + F.col("n_b"))
    return cut_lineage(pairs.where(can).select("a", "b"))


def differences(led: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(lead, sid, n, root, linked, need, less, tokens): what each set of ``led`` (lead, sid, n, root) differs in from its leader.

    Whether it links with the leader, and how many of these shingles it has at least in common with sets that it
    links with: ``need`` with those that don't link with the leader, ``less`` with those that do.
    """
    share = (100 - rule.percent) / (100 + rule.percent)  # of both sizes, that linked sets may differ in

    def at_least(common: float) -> int:
        return max(1, int(np.ceil(common - 1e-9)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            linked, need, less, tokens = [], [], [], []
            for k in range(len(left)):
                x, y = (np.frombuffer(side[k].as_buffer(), np.uint64) for side in (left, right))
                own = np.setxor1d(x, y, assume_unique=True)
                a, both = len(own), len(x) + len(y)
                linked.append(a * (100 + rule.percent) <= (100 - rule.percent) * both)
                # The other one differs from the leader in more than links allow, which bounds its part of the sum.
                need.append(at_least((a + share * (len(y) - len(x))) / 2))
                # One that links may differ from the leader in no more than the two have in common.
                less.append(min(need[-1], at_least((a - share * both) / (1 + share))))
                tokens.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("lead", "sid", "n", "root")],
                    pa.array(linked, pa.bool_()), pa.array(need, pa.int32()), pa.array(less, pa.int32()),
                    pa.array(tokens, pa.list_(pa.int64())),
                ],
                ["lead", "sid", "n", "root", "linked", "need", "less", "tokens"],
            )

    whole = (
        led.join(sets.select("sid", F.col("tokens").alias("left")), "sid")
        .join(sets.select(F.col("sid").alias("lead"), F.col("tokens").alias("right")), "lead")
        .select("lead", "sid", "n", "root", "left", "right")
    )
    return whole.mapInArrow(
        compare, "lead long, sid long, n int, root long, linked boolean, need int, less int, tokens array<long>"
    )


def difference_keys(differing: DataFrame) -> DataFrame:
    """(key, sid, n, root, role): the keys under which the sets of :func:`differences` meet.

    Role 0: a set that links with its leader, and so meets those that don't; 1: one that doesn't, under
    keys on which it meets others that don't; 2: under further ones, on which only those of role 0 find it.

    Shingles that one set of a leader differs in alone can't be in common and go; the rest is in order of rarity.
    Sets that have ``need`` in common share all choices of ``level`` of their first common ones, which lie
    among their first ``len - need + level``. A leader's sets have the highest level, 3 at most, that gives them few
    keys; where neither of two need so many, they meet under single shingles.
    """
    single = differing.select("lead", "sid", F.explode("tokens").alias("token"))
    often = single.groupBy("lead", "token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    ordered = (
        single.join(often, ["lead", "token"]).groupBy("lead", "sid")
        .agg(F.array_sort(F.collect_list(F.struct("m", "token"))).alias("common"))  # of one set
    )
    met = cut_lineage(
        differing.drop("tokens").join(ordered, ["lead", "sid"])
        .withColumn("common", F.col("common.token"))
        .withColumn("least", F.when(F.col("linked"), F.col("need")).otherwise(F.col("less")))
        .where("least <= size(common)")
    )

    def choices(level: int) -> Column:
        rest = (F.size("common") - F.greatest("least", F.lit(level))).cast("double")
        ways = F.lit(1.0)
        for i in range(1, level + 1):
            ways = ways * (rest + i) / i
        return F.sum(F.when(rest >= 0, ways).otherwise(0.0))

    few = F.count(F.lit(1)) * KEYS
    level = F.when(choices(3) <= few, 3).when(choices(2) <= few, 2).otherwise(1)
    levels = met.groupBy("lead").agg(level.alias("level"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
            at = pa.array([f[0] for f in found], pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(at) for c in ("lead", "sid", "n", "root")],
                    pa.array([f[1] for f in found], pa.int32()),
                    pa.array([f[2] for f in found], pa.list_(pa.int64())),
                ],
                ["lead", "sid", "n", "root", "role", "chosen"],
            )

        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("linked", "need", "less", "level", "common")]
            for k, (linked, need, less, top, common) in enumerate(zip(*columns, strict=True)):
                least = need if linked else less
                for level in {top, 1} if least < top else {top}:
                    rest, inner = (len(common) - max(c, level) for c in (least, need))
                    # On single shingles meet those that both need fewer than ``top``.
                    if level < top and need >= top:
                        inner = -level - 1
                    if rest < 0:
                        continue
                    for chosen in itertools.combinations(range(rest + level), level):
                        role = 0 if linked else 1 if chosen[-1] < inner + level else 2
                        found.append((k, role, [common[i] for i in chosen]))
                    if len(found) > 100_000:
                        yield rows(batch, found)
                        found = []
            yield rows(batch, found)

    keyed = met.join(levels, "lead").select("lead", "sid", "n", "root", "linked", "need", "less", "level", "common")
    made = keyed.mapInArrow(make, "lead long, sid long, n int, root long, role int, chosen array<long>")
    return made.select(F.xxhash64("lead", "chosen").alias("key"), "sid", "n", "root", "role")


def split_crowds(docs: DataFrame, members: DataFrame, reps: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) and pairs (sid, sid2) to compare, of the sets that share a key in ``members``.

    ``members``: (key, sid, n, root, role), see :func:`difference_keys`; here 1 for sets that others find
    and 0 for the rest, as a pair needs one that is found. Every link between groups is among the links
    or the pairs, or its sets link with one leader.
    """
    named = cut_lineage(members.select("sid").distinct().join(reps, "sid"))
    sets = cut_lineage(wanted_sets(docs, named, rule))
    links = members.sparkSession.createDataFrame([], "a long, b long")
    pairs = members.sparkSession.createDataFrame([], "sid long, sid2 long")
    role = F.col("role")
    for turn in range(SPLITS + 1):
        crowded = members.select("key").distinct()
        if turn:
            left, found, rest = (F.count_if(role == r).cast("double") for r in range(3))
            many = found * (found - 1) / 2 + left * (found + rest)
            sizes = cut_lineage(
                members.groupBy("key")
                .agg(F.min("root").alias("lo"), F.max("root").alias("hi"), many.alias("pairs"), F.count(F.lit(1)).alias("m"))
                .where("lo < hi AND pairs > 0").select("key", (F.col("pairs") > CROWD * F.col("m")).alias("crowd"))
            )
            last = turn == SPLITS
            calm = members.join(sizes.where(F.lit(last) | ~F.col("crowd")), "key", "left_semi")
            other = calm.where("role > 0").select("key", *[F.col(c).alias(f"{c}2") for c in ("sid", "n", "root", "role")])
            # Two that don't link with the leader meet once.
            once = (role == 0) | ((F.col("role2") == 1) & (F.col("sid") < F.col("sid2")))
            fit = (F.col("root") != F.col("root2")) & rule.sizes_fit(F.col("n"), F.col("n2"))
            met = calm.where("role < 2").join(other, "key").where(once & fit)
            pairs = pairs.union(met.select(F.least("sid", "sid2").alias("sid"), F.greatest("sid", "sid2").alias("sid2")))
            crowded = sizes.where("crowd").select("key")
            if last or crowded.isEmpty():
                break
        members = members.join(crowded, "key", "left_semi")
        leaders = members.groupBy("key").agg(F.min_by("sid", F.xxhash64("sid", F.lit(-1 - turn))).alias("lead"))
        led = members.join(leaders, "key").where("sid <> lead").select("lead", "sid", "n", "root").distinct()
        differing = cut_lineage(differences(led, sets, rule))
        links = links.union(differing.where("linked").select(F.col("sid").alias("a"), F.col("lead").alias("b")))
        members = cut_lineage(difference_keys(differing))
    return links, pairs.distinct()


def _meeting(rooted: DataFrame, rule: Rule) -> DataFrame:
    """The pair keys, and the lists of the sets that stand in as many open ones as links of theirs meet on."""
    # The smaller set of a link has at least ``percent`` of the larger one's size.
    least = F.expr(f"CAST(max(n) AS LONG) * {rule.percent * (100 - rule.percent)} DIV 80000") + 1
    lists = rooted.where("pos >= 0")
    enough = lists.groupBy("sid").agg(F.count(F.lit(1)).alias("open"), least.alias("least"))
    return lists.join(enough.where("open >= least").select("sid"), "sid", "left_semi").select(*rooted.columns).union(rooted.where("pos < 0"))


def _close(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[tuple]:
    """(table, pairs) of neighbouring keys; ``pairs``: an iterator over those that can link, of different groups.

    Each turn has (row, row, share), an array naming a row once: the share of both sets' size that parity bits differ in.
    """
    def pairs(n, pos, root, bits, ends):
        low = n * (100 - rule.percent) // (100 + rule.percent) + n * (100 - rule.percent) // 800 + 1  # see in_list
        for i, j in meetings(ends, np.flatnonzero(pos < low), lambda i, j: 100 * n[i] >= rule.percent * n[j]):
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            both, apart = n[i] + n[j], bits.apart(i, j)
            can = (100 + rule.percent) * apart <= (100 - rule.percent) * both
            yield i[can], j[can], apart[can] / both[can]

    for table in whole_groups(batches, "key"):
        key, n, pos, root = (table[c].to_numpy() for c in ("key", "n", "pos", "root"))
        bits = Parities(table["bits"].combine_chunks())
        yield table, pairs(n.astype(np.int64), pos, root, bits, group_ends(key))


def _by_key(rooted: DataFrame) -> DataFrame:
    return rooted.repartition("key").sortWithinPartitions("key", "n", "sid")


def nearest(rooted: DataFrame, rule: Rule) -> DataFrame:
    """(key, sid, n, pos, other, share, many): of each key the sets that meet one of another group that they can link to.

    ``rooted``: (key, sid, n, pos, root, bits); ``other``: the one nearest by parity bits, of how many.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, pairs in _close(batches, rule):
            sid = table["sid"].to_numpy()
            best, least, many = np.zeros(len(sid), np.int64), np.full(len(sid), np.inf), np.zeros(len(sid), np.int64)
            for i, j, share in pairs:
                for x, y in ((i, j), (j, i)):
                    many[x] += 1
                    less = (share < least[x]) | ((share == least[x]) & (sid[y] < best[x]))
                    least[x[less]], best[x[less]] = share[less], sid[y[less]]
            at = np.flatnonzero(many)
            own = [table[c].to_numpy()[at] for c in ("key", "sid", "n", "pos")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (*own, best[at], least[at], many[at])], ["key", "sid", "n", "pos", "other", "share", "many"]
            )

    return _by_key(rooted).mapInArrow(compare, "key long, sid long, n int, pos int, other long, share double, many long")


def all_close(rooted: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): all pairs of sets of different groups that meet and can link, of ``rooted`` as in :func:`nearest`."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, pairs in _close(batches, rule):
            sid = table["sid"].to_numpy()
            for i, j, _ in pairs:
                if len(i):
                    a, b = np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return _by_key(rooted).mapInArrow(compare, "a long, b long").distinct()


def link_groups(docs: DataFrame, keys: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """(node, root) of the groups that links make among the sets of ``keys`` (key, sid, n, pos).

    One round at least in which each set is compared with the nearest of another group alone; more while
    pairs are many and a round still links a fair part of the sets that it compares. Only sets
    that stand in a pair are fetched: ``reps`` (sid, rep, bits) names a document for each.
    """
    edges = keys.sparkSession.createDataFrame([], "a long, b long")
    named_by = reps.select("sid", "rep")
    is_found = rule.in_list(F.col("n"), F.col("pos"))
    keys = cut_lineage(_meeting(keys, rule))
    crowded = cut_lineage(keys.groupBy("key").agg(F.count_if(is_found).alias("listed")).where(F.col("listed") > 2 * CROWD).select("key"))
    some_crowded = not crowded.isEmpty()
    calm = keys.join(crowded, "key", "left_anti") if some_crowded else keys
    rooted = calm.withColumn("root", F.col("sid")).join(reps.select("sid", "bits"), "sid")

    def linked(pairs: DataFrame, known: bool) -> tuple[DataFrame, int, int]:
        """The true links among pairs, their number and that of the sets in pairs; ``known``: whether they can link by their bits."""
        pairs = cut_lineage(pairs)
        named = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        sets = cut_lineage(wanted_sets(docs, cut_lineage(named.join(named_by, "sid")), rule))
        found = cut_lineage(true_links(pairs if known else possible(pairs, sets, rule), sets, rule.percent))
        links, met = found.count(), sets.count()
        discard(pairs, sets)
        return found, links, met

    links = met = 0
    for step in itertools.count():
        near = cut_lineage(nearest(rooted, rule))
        entries, left = near.agg(F.count(F.lit(1)), F.sum("many") / 2).first()
        if step and not entries:
            break
        last = step > 0 and (left <= PAIRS_PER_KEY * entries or links <= met / ROUND_PAYS)
        if last:
            pairs = all_close(rooted, rule)
        else:
            best = near.groupBy("sid").agg(F.min(F.struct("share", "other")).alias("best")).select("sid", "best.other")
            pairs = best.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct()
        found, links, met = linked(pairs, True)
        edges = edges.union(found)
        groups = components(edges)
        if last:
            break
        # Sets that meet none they can link to are done, and keys of one group tell nothing more about groups.
        rooted = cut_lineage(
            near.select("key", "sid", "n", "pos").join(groups.withColumnRenamed("node", "sid"), "sid", "left")
            .withColumn("root", F.coalesce("root", "sid")).join(reps.select("sid", "bits"), "sid")
        )
        open_keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        rooted = rooted.join(open_keys, "key", "left_semi")
    if some_crowded:
        # What is left are pairs that meet on crowded keys alone.
        hot = (
            keys.join(crowded, "key", "left_semi").join(groups.withColumnRenamed("node", "sid"), "sid", "left")
            .withColumn("root", F.coalesce("root", "sid"))
        )
        members = cut_lineage(_meeting(hot.select(*keys.columns, "root"), rule).select("key", "sid", "n", "root", is_found.cast("int").alias("role")))
        told, more = split_crowds(docs, members, named_by, rule)
        found, _, _ = linked(more.select(F.col("sid").alias("a"), F.col("sid2").alias("b")), False)
        groups = components(edges.union(told).union(found))
    return groups


def join_documents(docs: DataFrame, rule: Rule = OP4) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``."""
    seen = cut_lineage(survey(docs, rule))
    found = seen.where("kind = 0").select("doc_id", F.col("a").alias("sid"), F.col("n").alias("n_shingles"), "bits")
    sets = cut_lineage(
        found.where("sid IS NOT NULL").groupBy("sid")
        .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.any_value("bits").alias("bits"))
    )
    common = (
        seen.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "a").limit(HEAVY).toArrow()
    )
    heavy = common["a"].to_numpy().view(np.uint64)
    by_hash = np.argsort(heavy)
    classes = sets.groupBy(F.least(F.floor(F.col("n") * (100 - rule.percent) / 100), F.lit(CLASSES - 1)).alias("d")).count().collect()
    others = F.sum(F.greatest(F.col("n") / 1000 - 1, F.lit(0))) * sum(r["count"] for r in classes) / F.sum("a")
    spread = seen.where("kind = 2 AND a > 0").agg(others).first()[0]
    limit = boundary({r["d"]: r["count"] for r in classes}, 1 + (spread or 0.0), rule.percent)
    keys = cut_lineage(set_keys(docs, heavy[by_hash], common["n"].to_numpy()[by_hash], limit, rule))
    listed = F.count_if(rule.in_list(F.col("n"), F.col("pos")))
    # Counts, the join with them and the removal of repeats share one shuffle.
    by_key = keys.repartition("key").distinct()
    shared = by_key.groupBy("key").agg(F.count(F.lit(1)).alias("m"), listed.alias("listed")).where("m > 1 AND listed > 0")
    every = keys
    keys = cut_lineage(by_key.join(shared.select("key").hint("shuffle_hash"), "key", "left_semi"))
    discard(every)
    groups = link_groups(docs, keys, sets.select("sid", "rep", "bits"), rule)
    discard(keys)
    grouped = cut_lineage(
        found.drop("bits").join(groups.withColumnRenamed("node", "sid"), "sid", "left")
        .withColumn("root", F.coalesce("root", "sid"))
    )
    least = grouped.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    own = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return grouped.join(least, "root", "left").select("doc_id", "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule = OP4) -> DataFrame:
    """Rows of ``docs``, with all their columns: of each group the document with the smallest id.

    Of equal ids the one with the smallest hash of its text stays, and of rows that are equal in
    both one; documents without words all stay.
    """
    text = F.col("text").cast("string")
    keyed = docs.select(
        F.struct("*").alias("row"), F.struct("doc_id", F.xxhash64(text).alias("t")).alias("doc_id"), text.alias("text")
    )
    groups = join_documents(keyed.select("doc_id", "text"), rule)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return keyed.select("doc_id", "row").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("row.*")
