"""Lines meet within tasks: no table of postings or pairs is written, whatever the keys are dealt by."""

import random

import numpy as np
import pyarrow as pa
import pytest

from daytrail.llm import line_dedup, meeting
from tests.llm.test_line_words import brute


def texts(many, lines=10, words=40):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(600)]
    return [(k, "\n".join(" ".join(rng.sample(vocabulary, words)) for _ in range(lines))) for k in range(many)]


def near_copies(many):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(45)]
    rows = []
    for k in range(many):
        line = list(base)
        for at in rng.sample(range(45), rng.randint(0, 9)):
            line[at] = rng.choice([f"e{k}x{at}", f"s{at % 4}", ""])
        rows.append((1000 + k, " ".join(line)))
    return rows


def removed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["removed"] for r in line_dedup.line_report(docs, width=1).collect()}


def test_tables_have_few_rows_for_each_line(spark, monkeypatch):
    written = []
    plain = line_dedup.cut_lineage

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "cut_lineage", counted)
    rows = texts(60)
    assert removed(spark, rows) == brute(rows)
    assert sum(written) < 5 * 600  # each line has nine keys


@pytest.mark.parametrize("hot,waiting,rounds", [(None, 1 << 20, 3), (0, 50, 3), (10, 50, 0), (0, 1 << 20, 1)])
def test_hot_tokens_and_crowds_against_all_pairs(spark, monkeypatch, hot, waiting, rounds):
    if hot is not None:
        monkeypatch.setattr(line_dedup, "hot_class", lambda counts: hot)
    monkeypatch.setattr(line_dedup, "WAITING", waiting)
    monkeypatch.setattr(line_dedup, "ROUNDS", rounds)
    rows = near_copies(70) + texts(3) + [(2000 + k, "a b c d" + " e" * (k % 2) + " f" * (k % 3)) for k in range(6)]
    expected = brute(rows)
    assert sum(map(len, expected.values())) > 20
    assert removed(spark, rows) == expected


def test_groups_stay_whole(monkeypatch):
    monkeypatch.setattr(meeting, "GROUPS", 100)
    keys = np.repeat(np.arange(40), np.random.default_rng(1).integers(1, 30, 40))
    table = pa.table({"key": keys, "x": np.arange(len(keys))})
    parts = list(meeting.whole_groups(iter(table.to_batches(max_chunksize=7)), "key"))
    assert len(parts) > 3
    assert np.concatenate([p["x"].to_numpy() for p in parts]).tolist() == list(range(len(keys)))
    seen = [set(p["key"].to_pylist()) for p in parts]
    assert sum(map(len, seen)) == 40


def test_meetings_are_all_pairs_of_a_group():
    keys = np.array([1, 1, 1, 4, 5, 5])
    ends = meeting.group_ends(keys)
    assert ends.tolist() == [3, 3, 3, 4, 6, 6]
    got = [(i, j) for a, b in meeting.meetings(ends, np.arange(6), lambda i, j: i >= 0) for i, j in zip(a, b, strict=True)]
    assert sorted(got) == [(0, 1), (0, 2), (1, 2), (4, 5)]
    assert meeting.group_ends(np.zeros(0, np.int64)).tolist() == []
