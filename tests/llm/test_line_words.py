"""Lines are alike by their distinct words: the query against all pairs of lines."""

import re

import numpy as np
import pytest

from daytrail.llm import line_dedup
from daytrail.llm.catalog import QUERIES


def brute(rows):
    """Removed line numbers by doc_id (ids are unique), from every pair of lines."""
    lines = []
    for doc_id, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            words = {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", line)}
            if words:
                lines.append((doc_id, k, frozenset(words)))
    first, removed = {}, {doc_id: [] for doc_id, _ in rows}
    for at, (_, _, words) in enumerate(lines):
        first.setdefault(words, at)
    for at, (doc_id, k, words) in enumerate(lines):
        if first[words] < at or any(
            f < at and 4 * len(w) <= 5 * len(words) and 4 * len(words) <= 5 * len(w)
            and 10 * len(w & words) >= 8 * len(w | words)
            for w, f in first.items() if w != words
        ):
            removed[doc_id].append(k)
    return removed


def test_the_query_against_all_pairs_of_words(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r["doc_id"]: r["removed"] for r in QUERIES["op3_line_dedup"](spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("pairs_per_key", [4, 0])
def test_one_edited_word_in_a_line(spark, monkeypatch, pairs_per_key):
    monkeypatch.setattr(line_dedup, "PAIRS_PER_KEY", pairs_per_key)
    base = [f"word{i}" for i in range(12)]
    rows = [(k, " ".join(base[:k] + [f"other{k}"] + base[k + 1 :]) + f"\nown{k} line{k} of{k}") for k in range(12)]
    rows += [(20, "a b c d e\na b c d\nb a d c\na b c"), (21, "d c b a e"), (30, "x\n" + " ".join(base)), (31, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    assert expected[20] == [1, 2] and expected[21] == [0] and expected[30] == [1]
    assert {r["doc_id"]: r["removed"] for r in line_dedup.line_report(docs, width=1).collect()} == expected


def test_set_numbers_take_all_bits_of_a_hash(monkeypatch):
    # Four bits of a hash in the key: many words share one, as some do among millions with 42.
    monkeypatch.setattr(line_dedup, "_HASH", 4)
    text = "\n".join([*(f"word{i}" for i in range(200)), " ".join(f"word{i}" for i in range(50)) + " word0 WORD7"]).encode()
    raw, weights = np.frombuffer(text, np.uint8), np.zeros(line_dedup.COUNTERS, np.uint64)
    sets = line_dedup.LineSets(raw, np.array([0]), np.array([len(text)]), weights, 1)
    assert len(set(sets.number.tolist())) == 201 and sets.n.tolist() == [1] * 200 + [50]
