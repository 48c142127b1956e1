"""Suffix-array dedup against plain search for repeated strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from daytrail.llm import suffix_dedup, textscan
from daytrail.llm.suffix_dedup import Rule

DOCS = "doc_id long, text string, lang string, key string, ctx string, low int, first int, a long, spans string"


def small(spark, rows):
    return spark.createDataFrame([(*r, "en", "k", "c", 1, 1, 1, "s") for r in rows], DOCS)


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    met = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if met[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((doc_id, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(spark, rows, rule):
    got = suffix_dedup.report(small(spark, rows).repartition(3), rule)
    return sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def texts(seed):
    """Near copies, shared passages, periods, cases and borders of texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdéX ", k=rng.randint(1, 6)))
    passage = [" ".join(word() for _ in range(n)) for n in (3, 5, 8, 20)]
    base = " ".join(word() for _ in range(40))
    rows = []
    for i in range(60):
        kind = rng.randrange(6)
        if kind == 0:
            cut = sorted(rng.sample(range(len(base)), 4))
            text = base[: cut[0]] + word() + base[cut[1] : cut[2]] + word() + base[cut[3] :]
        elif kind == 1:
            text = word() + rng.choice(passage) + word() + rng.choice(passage)
        elif kind == 2:
            text = rng.choice(["ab", "x", "abcdefghij"]) * rng.randint(1, 30) + word()
        elif kind == 3:
            text = base[rng.randrange(60) :][: rng.randint(0, 90)]
        else:
            text = " ".join(word() for _ in range(rng.randint(0, 40)))
        rows.append((i, text))
    return [*rows, rows[5], (61, rows[7][1]), (62, None), (None, ""), (None, rows[0][1].swapcase())]


@pytest.mark.parametrize("rule", [Rule(12, 3), Rule(20, 5), Rule(7, 7)])
def test_repeats_against_plain_search(spark, rule):
    rows = texts(rule.length)
    assert removed(spark, rows, rule) == plain(rows, rule.length)


def test_small_buckets_compare_across_their_borders(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET", 40)
    monkeypatch.setattr(suffix_dedup, "SMALL", 3)
    rng = random.Random(2)
    common = "the passage that every text has"
    rows = texts(4) + [(100 + i, f"{rng.random()}{common}{rng.random()}") for i in range(80)]
    assert removed(spark, rows, Rule(24, 6)) == plain(rows, 24)


def test_long_texts_come_in_parts(monkeypatch, spark):
    monkeypatch.setattr(textscan, "PIECE", 64)
    rows = texts(8) + [(200, "".join(random.Random(1).choices("ab", k=700)))]
    column = __import__("pyarrow").array([t or "" for _, t in rows])
    rule = Rule(12, 3)
    windows = {}
    for i, before, found in suffix_dedup.scanned(column, rule):
        for d, at, low, high in zip(found.doc, found.at, found.low, found.high, strict=True):
            for r in range(low, high + 1):
                start = at - found.start[d] + before - r
                assert (i + d, start) not in windows
                windows[i + d, start] = r
    sizes = [len((t or "").encode()) for _, t in rows]
    assert len(windows) == sum(max(0, n - 11) for n in sizes)
    by_window = {}
    for (d, start), r in windows.items():
        by_window.setdefault((rows[d][1] or "").encode()[start : start + 12], set()).add(r)
    assert all(len(r) == 1 for r in by_window.values())  # equal windows have equal anchors


def test_order_is_that_of_bytes():
    rng = np.random.default_rng(1)
    matrix = rng.integers(97, 99, (700, 21), dtype=np.uint8)
    matrix[:200, :18] = matrix[0, :18]
    order = suffix_dedup.multikey_order(matrix)
    rows = [bytes(r) for r in matrix]
    assert [rows[k] for k in order] == sorted(rows)


def test_no_rows_and_no_repeats(spark):
    assert removed(spark, [], Rule()) == []
    rows = [(1, "short"), (2, "".join(random.Random(4).choices("abcdefgh", k=900))), (3, None)]
    assert removed(spark, rows, Rule()) == plain(rows, 400)
