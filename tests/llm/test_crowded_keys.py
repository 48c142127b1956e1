"""Many near copies that do not link: they share their rare shingles, and are split by what they differ in."""

import random

import pytest

from daytrail.llm import ngram_join
from tests.llm.test_language_and_join import brute, joined


def copies(many, words=130, edits=(2, 6)):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for k in range(many):
        text = list(base)
        for e, at in enumerate(rng.sample(range(words), rng.randint(*edits))):
            # Some edits are the same in several copies.
            text[at] = rng.choice([f"x{k}e{e}", f"same{at % 3}", ""])
        rows.append((k + 1, " ".join(text)))
    return rows


@pytest.mark.parametrize("crowd,splits,limit", [(16, 3, None), (0, 1, 30), (0, 3, -1), (1, 2, None)])
def test_crowds_against_all_pairs(spark, monkeypatch, crowd, splits, limit):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "SPLITS", splits)
    if limit is not None:
        monkeypatch.setattr(ngram_join, "boundary", lambda *_: limit)
    rows = copies(70) + [(1000 + i, t) for i, t in copies(40, 47, (0, 3))]
    rows = [(i, t.replace("w", "v")) if i >= 1000 else (i, t) for i, t in rows]
    assert joined(spark, rows) == brute(rows)


def test_few_pairs_of_a_crowd_are_compared(spark, monkeypatch):
    compared = []
    plain = ngram_join.true_links
    monkeypatch.setattr(ngram_join, "true_links", lambda pairs, *x: compared.append(pairs.count()) or plain(pairs, *x))
    rows = copies(160, edits=(5, 6))
    assert joined(spark, rows) == brute(rows)
    assert compared[-1] < 160 * 10  # 12,720 pairs in all
