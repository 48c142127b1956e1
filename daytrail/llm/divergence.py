"""Audit of how sources diverge: terms kept by iceberg prefix refinement, then exact distances.

A term is kept for a language when at least ``LEAST_DOCS`` of its documents hold it. A document
that holds a term holds every prefix of it, so terms are found by growing prefixes: of ``FIRST``
bytes, then of twice as many, and so on. On a level a document counts once for each of its
prefixes whose shorter prefix reached the bar; terms that end on the level are counted whole, by
source. Prefixes below the bar are discarded with all their terms, and levels end when no prefix
is left that goes on. So the many rare terms of a corpus are never shuffled as terms.

A task counts a batch of documents at once and gives one row a prefix or (source, term). Kept
prefixes reach the next level as a filter of ``FILTER_BITS`` bits, whatever their number: a
prefix that passes by chance is counted and discarded again, so the filter sets costs, never
results. Terms themselves are counted as strings; only prefixes are 64-bit hashes.

Distances are whole numbers: p = 1 + floor(10^9 (count + 5) / (N + 5 V)) is divided in three steps
of a thousand, exact for corpora of up to nine quadrillion words. For pairs of sources, terms go
to blocks of about ``CELLS`` (term, source) cells; a block is a small matrix whose pair sums are
added up, so neither pairs of documents nor terms times pairs leave a task.

Defined cases: null text, language or source count as ''; a row is a document, so repeated rows
count each; a language without kept terms has V = 0 and pairs of value 0; a single source has no
pairs; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.llm.textscan import Spans, mixed, pieces, span_hashes, utf8
from daytrail.plans.ranking import over
from daytrail.session import cut_lineage

LEAST_DOCS = 30
TOP_TERMS = 50
FIRST = 4
FILTER_BITS = 1 << 23
CELLS = 1 << 14

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def named(docs: DataFrame) -> DataFrame:
    """lang, source and text as strings, null as ''."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def _codes(column: pa.Array) -> np.ndarray:
    """A 64-bit number for the name of each row."""
    coded = column.dictionary_encode()
    numbers = np.array([_hash(x) for x in coded.dictionary.to_pylist()], np.uint64)
    return numbers[coded.indices.to_numpy(zero_copy_only=False)]


def _once_a_document(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct keys: a place of each, the documents that hold it, and its occurrences."""
    _, first, times = np.unique(mixed(keys ^ mixed(doc.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    _, again, inverse = np.unique(keys[first], return_index=True, return_inverse=True)
    return first[again], np.bincount(inverse), np.bincount(inverse, weights=times).astype(np.int64)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(len(bits) * 64 - 1)).astype(np.int64)
    return ((bits[at >> 6] >> (at & 63)) & 1).astype(bool)


def level(docs: DataFrame, last: int, step: int, bits: np.ndarray | None) -> DataFrame:
    """(lang, source, term, prefix, n_docs, n_terms) of one level, over all of ``named`` documents.

    Rows with a ``term`` count terms of ``last`` + 1 to ``step`` bytes by group; rows with a
    ``prefix`` count documents by the hash of a language and a prefix of ``step`` bytes.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts, ends = utf8(batch.column("text"))
            lang, source = batch.column("lang"), batch.column("source")
            langs = _codes(lang)
            groups = mixed(langs + np.uint64(1)) ^ _codes(source)
            for i, j in pieces(starts, ends):
                low, high = int(starts[i]), int(ends[i:j].max())
                if high == low:
                    continue
                spans = Spans(raw, starts[i:j], ends[i:j], _NOT_LETTER)
                text, start, size = _LOWER[raw[low:high]], spans.start - low, spans.end - spans.start
                doc = spans.doc + i
                if last:
                    some = np.flatnonzero(size > last)
                    parent = span_hashes(text, start[some], start[some] + last)
                    some = some[passes(bits, mixed(parent ^ langs[doc[some]]))]
                    start, size, doc = start[some], size[some], doc[some]
                whole = np.flatnonzero(size <= step)
                if len(whole):
                    keys = mixed(span_hashes(text, start[whole], start[whole] + size[whole]) ^ groups[doc[whole]])
                    at, n_docs, n_terms = _once_a_document(keys, doc[whole])
                    at, data = whole[at], text.tobytes()
                    terms = [data[s:e] for s, e in zip(start[at].tolist(), (start[at] + size[at]).tolist(), strict=True)]
                    rows = pa.array(doc[at])
                    yield pa.RecordBatch.from_arrays(
                        [lang.take(rows), source.take(rows), pa.array(terms, pa.binary()).cast(pa.string()),
                         pa.nulls(len(at), pa.int64()), pa.array(n_docs), pa.array(n_terms)],
                        ["lang", "source", "term", "prefix", "n_docs", "n_terms"],
                    )
                longer = np.flatnonzero(size > step)
                if len(longer):
                    keys = mixed(span_hashes(text, start[longer], start[longer] + step) ^ langs[doc[longer]])
                    at, n_docs, n_terms = _once_a_document(keys, doc[longer])
                    none = pa.nulls(len(at), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [none, none, none, pa.array(keys[at].view(np.int64)), pa.array(n_docs), pa.array(n_terms)],
                        ["lang", "source", "term", "prefix", "n_docs", "n_terms"],
                    )

    found = docs.mapInArrow(scan, "lang string, source string, term string, prefix long, n_docs long, n_terms long")
    return found.groupBy("lang", "source", "term", "prefix").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms"))


def prefix_filter(prefixes: DataFrame) -> np.ndarray:
    """One bit for each kept prefix; at most ``FILTER_BITS / 64`` numbers reach the driver."""
    bit = f"pmod(prefix, {FILTER_BITS})"
    rows = (
        prefixes.groupBy(F.expr(f"CAST({bit} DIV 64 AS INT)").alias("word"))
        .agg(F.expr(f"bit_or(shiftleft(1L, CAST({bit} % 64 AS INT)))").alias("bits"))
        .toArrow()
    )
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return bits


def kept_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n): occurrences of each language's kept terms by group, where there are any."""
    last, step, bits, ended = 0, FIRST, None, None
    while True:
        found = cut_lineage(level(docs, last, step, bits))
        terms = found.where("term IS NOT NULL").drop("prefix")
        ended = terms if ended is None else ended.unionByName(terms)
        bits = prefix_filter(found.where(F.col("prefix").isNotNull() & (F.col("n_docs") >= least)))
        if not bits.any():
            break
        last, step = step, 2 * step
    kept = ended.groupBy("lang", "term").agg(F.sum("n_docs").alias("d")).where(F.col("d") >= least)
    return ended.join(kept, ["lang", "term"]).select("lang", "source", "term", F.col("n_terms").alias("n"))


def scaled_share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), in whole numbers; null without terms.

    count + 5 is at most total + 5 terms, so each step of a long division by thousands stays a long.
    """
    whole = total + 5 * terms
    part, rest = F.lit(0).cast("long"), count + 5
    for _ in range(3):
        rest = rest * 1000
        digits = F.call_function("div", rest, whole)
        part, rest = part * 1000 + digits, rest - digits * whole
    return F.when(terms > 0, 1 + part)


def _pair_sums(table: pa.Table) -> pa.Table:
    """Sums of differences for each pair of sources in one block of terms."""
    n, p = table.column("idx").to_numpy(), table.column("p").to_numpy()
    base_row = table.column("term").is_null().to_numpy()
    sources = int(base_row.sum())
    base = np.zeros(sources, np.int64)
    base[n[base_row]] = np.nan_to_num(p[base_row]).astype(np.int64)
    terms = table.filter(pa.array(~base_row)).column("term").combine_chunks().dictionary_encode()
    cells = np.repeat(base[:, None], len(terms.dictionary), axis=1)
    cells[n[~base_row], terms.indices.to_numpy()] = p[~base_row].astype(np.int64)
    one = np.arange(sources)
    rows = []
    for a in range(sources):
        value = np.array([np.abs(cells[a] - cells[b]).sum() for b in range(sources)], np.int64)
        rows.append(value)
    value = np.array(rows, np.int64).reshape(sources, sources)
    other = ~np.eye(sources, dtype=bool)
    a, b = np.broadcast_to(one[:, None], other.shape)[other], np.broadcast_to(one, other.shape)[other]
    lang = table.column("lang")[0].as_py()
    return pa.table({
        "lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int64()),
        "b": pa.array(b, pa.int64()), "value": pa.array(value[other], pa.int64()),
    })


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources, and each group's leading terms."""
    docs = named(docs)
    counts = cut_lineage(kept_counts(docs, least))
    terms = cut_lineage(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut_lineage(
        docs.select("lang", "source").distinct()
        .join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .fillna(0, ["total", "v", "lang_total"])
        .withColumns({
            # A row for each group of a language.
            "idx": (F.row_number().over(over(["lang"], "source")) - 1).cast("long"),
            "sources": F.count(F.lit(1)).over(over(["lang"])),
        })
        .withColumn("blocks", F.greatest(F.ceil(F.col("v") * F.col("sources") / CELLS), F.lit(1)).cast("long"))
    )
    v = F.col("v")
    cells = cut_lineage(
        counts.join(groups, ["lang", "source"]).join(terms, ["lang", "term"])
        .withColumns({"p": scaled_share(F.col("n"), F.col("total"), v), "q": scaled_share(F.col("lang_n"), F.col("lang_total"), v)})
        .select("lang", "source", "term", "idx", "blocks", "p", "q")
    )
    leading = (
        cells.where("p > q").withColumn("value", F.col("p") - F.col("q"))
        .withColumn("rank", F.row_number().over(over(["lang", "source"], F.col("value").desc(), F.col("term"))))
        .where(F.col("rank") <= top)
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    )
    zero = F.lit(0).cast("long")
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    entries = cells.select("lang", block.alias("block"), "idx", "term", "p").unionByName(
        groups.select(
            "lang", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), "idx",
            F.lit(None).cast("string").alias("term"), scaled_share(zero, F.col("total"), v).alias("p"),
        )
    )
    sums = (
        entries.groupBy("lang", "block").applyInArrow(_pair_sums, "lang string, a long, b long, value long")
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    )
    names = groups.select("lang", "idx", "source")
    pairs = (
        sums.join(names.withColumnRenamed("idx", "a"), ["lang", "a"])
        .join(names.select("lang", F.col("idx").alias("b"), F.col("source").alias("item")), ["lang", "b"])
        .withColumn("rank", F.row_number().over(over(["lang", "source"], F.col("value").desc(), F.col("item"))))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    )
    return pairs.unionByName(leading)
