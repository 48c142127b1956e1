"""Token counts kept up by signed changes.

A batch of changes inserts documents, deletes them, or revises counts (a new tokenizer version,
source, language or text). The ledger turns it into signed rows: +1 document and +n tokens for what
is new, -1 and -n for what was there. Signed rows add up, so totals by source, language and
tokenizer version are the former totals plus the batch's sums, and no document is counted again.

A batch has a name. Its signed rows are written first, its totals last, each to a folder of that
name; the totals' success mark commits it. A batch that broke off is written again from the start,
over its own folders; a batch that is committed is left alone when it comes again. The former state
is named by the caller (``after``), so that batches form a chain whatever order files are listed in.

Tokens are counted with a public byte-pair vocabulary in Arrow batches; the folder of vocabularies
is a parameter.

Defined cases: null and empty texts have 0 tokens; a batch holds one change for a document and
tokenizer: of repeated ones the last counts (highest ``n_tokens``, then language and source);
deleting what isn't there, or a revision to the same values, changes nothing; totals that fall to
no documents vanish; null ids, sources and languages are values of their own; an empty batch
commits the former totals; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daytrail.session import cut_lineage

VOCABULARIES = "/opt/tokenizers"
# Fixed value: the public pre-token pattern that goes with these vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

GROUP = ["source", "lang", "tokenizer"]
SIGNED = "doc_id {kind}, source string, lang string, tokenizer string, docs long, tokens long"


@functools.cache
def encoding(folder: str, name: str):
    import tiktoken

    lines = (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters encoded at once; longer texts are cut where white space begins.
PIECE = 1 << 16


def count_text(encoder, text: str) -> int:
    """Number of tokens. Pieces start at white space before a word, where no token goes across."""
    at, n = 0, 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at + 1, at + PIECE)
        # One space before a letter begins a token of its own.
        while cut > at and not (text[cut + 1].isalpha() and not text[cut - 1].isspace()):
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            break
        n += len(encoder.encode_ordinary(text[at:cut]))
        at = cut
    return n + len(encoder.encode_ordinary(text[at:]))


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], folder: str = VOCABULARIES) -> DataFrame:
    """``docs`` (doc_id, source, lang, text, wanted) with one row for each tokenizer in ``wanted``.

    ``tokenizers``: version name to vocabulary. Rows: (doc_id, source, lang, tokenizer, n_tokens).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column("text"), batch.column("wanted").to_pylist()
            take, names, counts = [], [], []
            for i, versions in enumerate(wanted):
                text = texts[i].as_py() or ""
                for version in versions:
                    take.append(i)
                    names.append(version)
                    counts.append(count_text(encoding(folder, tokenizers[version]), text))
            rows = pa.array(take, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(rows) for c in ("doc_id", "source", "lang")), pa.array(names, pa.string()), pa.array(counts, pa.int64())],
                ["doc_id", "source", "lang", "tokenizer", "n_tokens"],
            )

    return docs.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"), "wanted").mapInArrow(
        scan, f"doc_id {kind}, source string, lang string, tokenizer string, n_tokens long"
    )


class Ledger:
    """Signed rows and totals under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, id_type: str = "bigint"):
        self.spark, self.root = spark, root.rstrip("/")
        self.signed_schema = SIGNED.format(kind=id_type)

    def _path(self, what: str, batch: str) -> str:
        return f"{self.root}/{what}/batch={batch}"

    def is_committed(self, batch: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path('totals', batch)}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def signed(self, batches: list[str]) -> DataFrame:
        """The signed rows of committed batches."""
        if not batches:
            return self.spark.createDataFrame([], self.signed_schema)
        return self.spark.read.schema(self.signed_schema).parquet(*[self._path("signed", b) for b in batches])

    def totals(self, batch: str | None) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) after a committed batch; none before the first."""
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        if batch is None:
            return self.spark.createDataFrame([], schema)
        if not self.is_committed(batch):
            raise ValueError(f"batch {batch} is not committed")
        return self.spark.read.schema(schema).parquet(self._path("totals", batch))

    def commit(self, batch: str, after: list[str], changes: DataFrame) -> bool:
        """Applies ``changes`` (doc_id, source, lang, tokenizer, n_tokens; null tokens: delete).

        ``after``: all former batches, oldest first. False if the batch was committed before.
        """
        if self.is_committed(batch):
            return False
        key = ["doc_id", "tokenizer"]
        wanted = (
            changes.groupBy(*key)
            .agg(F.max(F.struct("n_tokens", "lang", "source")).alias("c"))
            .select(*key, "c.source", "c.lang", F.col("c.n_tokens").alias("tokens"))
        )
        new = wanted.where("tokens IS NOT NULL").select(
            "doc_id", *GROUP, F.lit(1).cast("long").alias("docs"), "tokens", F.lit(True).alias("named")
        )
        nothing = F.lit(0).cast("long")
        gone = wanted.where("tokens IS NULL").select("doc_id", *GROUP, nothing, nothing, F.lit(True))
        was = self.signed(after).select("doc_id", *GROUP, -F.col("docs"), -F.col("tokens"), F.lit(False))
        # All rows of one document and version meet; rows that the batch doesn't name add nothing.
        met = new.union(gone).union(was)
        named = F.max("named").over(Window.partitionBy(*key))
        # A revision to the same values leaves nothing.
        signed = (
            met.withColumn("named", named).where("named")
            .groupBy("doc_id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .where("docs <> 0 OR tokens <> 0")
        ) if after else new.drop("named")
        signed.write.mode("overwrite").parquet(self._path("signed", batch))
        change = self.signed([batch]).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        totals = (
            self.totals(after[-1] if after else None).union(change)
            .groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .where("docs <> 0")
        )
        totals.write.mode("overwrite").parquet(self._path("totals", batch))
        return True


def ledger_of_documents(docs: DataFrame, root: str, folder: str = VOCABULARIES) -> DataFrame:
    """Three batches over documents, the second sent twice; the totals after them.

    1: every document is inserted under ``bpe-1``. 2: documents that aren't in English are revised:
    they leave ``bpe-1`` for ``bpe-2``, a vocabulary for many languages. 3: copies of a text, all
    but the one with the smallest id, are deleted.
    """
    both = F.array(F.lit("bpe-1"), F.lit("bpe-2"))
    wanted = F.when(F.col("lang") == "en", F.array(F.lit("bpe-1"))).otherwise(both)
    counts = cut_lineage(
        count_tokens(
            docs.select("doc_id", "source", "lang", "text", wanted.alias("wanted")),
            {"bpe-1": "byte_bpe_50k", "bpe-2": "byte_bpe_multi_50k"},
            folder,
        )
    )
    ledger = Ledger(docs.sparkSession, root, docs.schema["doc_id"].dataType.simpleString())
    none = F.lit(None).cast("long").alias("n_tokens")
    ledger.commit("1", [], counts.where("tokenizer = 'bpe-1'"))
    moved = counts.where("tokenizer = 'bpe-2'")
    revised = moved.union(moved.select("doc_id", "source", "lang", F.lit("bpe-1"), none))
    ledger.commit("2", ["1"], revised)
    ledger.commit("2", ["1"], revised)
    texts = docs.where("text IS NOT NULL").select("doc_id", F.md5(F.col("text").cast("binary")).alias("t"))
    first = texts.groupBy("t").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = texts.join(first, "t").where("doc_id > first").select("doc_id")
    deleted = copies.select(
        "doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"),
        F.explode(both).alias("tokenizer"), none,
    )
    ledger.commit("3", ["1", "2"], deleted)
    return ledger.totals("3")
