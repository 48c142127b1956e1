import re

import pytest

from daytrail.llm import line_dedup

SCHEMA = "doc_id long, text string, lang string, removed string, first string"


def brute(rows):
    """Removed line numbers by (doc_id, text), from every pair of lines."""
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    lines = []
    for doc_id, text in docs:
        for k, line in enumerate(text.split("\n")):
            words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
            if words:
                runs = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
                lines.append(((doc_id, text), k, frozenset(runs)))
    removed = {doc: [] for doc in docs}
    first = {}
    for at, (_, _, words) in enumerate(lines):
        first.setdefault(words, at)
    for at, (doc, k, words) in enumerate(lines):
        earlier = first[words] < at or any(
            f < at and 10 * len(w & words) >= 8 * len(w | words) for w, f in first.items() if w != words
        )
        if earlier:
            removed[doc].append(k)
    return removed


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    expected = brute(rows)
    got = line_dedup.line_report(docs).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t in rows}
    for r in got:
        assert r["removed"] == expected.get((r["doc_id"], texts[r["doc_id"]]), [])
        assert r["n_removed"] == len(r["removed"])
    return expected


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sum(map(len, check(spark, rows).values())) > 10


@pytest.mark.parametrize("pairs_per_key", [4, 0])
def test_near_copies_ties_and_nulls(spark, monkeypatch, pairs_per_key):
    monkeypatch.setattr(line_dedup, "PAIRS_PER_KEY", pairs_per_key)
    base = [f"word{i}" for i in range(60)]
    rows = [(k, " ".join(base[:k] + [f"other{k}"] + base[k + 1 :]) + f"\nown line number{k} of doc{k} here") for k in range(0, 60, 5)]
    rows += [(120, None), (121, ""), (122, "\n\n"), (None, "Word0 and more"), (23, "a b c d e\na b c d\nA B C D E\n x"), (24, "x")]
    rows += [(23, "a b c d e\na b c d\nA B C D E\n x")]
    expected = check(spark, rows)
    assert expected[(23, "a b c d e\na b c d\nA B C D E\n x")] == [2]
    assert sum(map(len, expected.values())) > 5


def test_texts_without_removed_lines(spark):
    docs = spark.createDataFrame([(1, "one two three four five\nkeep", "e"), (2, "One two three four FIVE\n\nlast", "e"), (3, None, "e")], "doc_id long, text string, t string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs).collect()}
    assert got == {1: "one two three four five\nkeep", 2: "\nlast", 3: None}


def test_empty_table(spark):
    assert line_dedup.line_report(spark.createDataFrame([], SCHEMA)).collect() == []
