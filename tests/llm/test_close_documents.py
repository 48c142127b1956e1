"""Sets of a key are compared in place: few pairs and no lists of what crowds differ in."""

import random

import numpy as np
import pyarrow as pa
import pytest

from daytrail.llm import ngram_join
from tests.llm.test_crowded_keys import copies
from tests.llm.test_language_and_join import brute, joined


def test_a_crowd_makes_no_list_of_differences(spark, monkeypatch):
    def made(*_):
        raise AssertionError("shingles that a crowd differs in were listed")

    monkeypatch.setattr(ngram_join, "difference_keys", made)
    rows = copies(160)
    assert joined(spark, rows) == brute(rows)


def test_long_texts_that_share_passages_are_not_compared(spark, monkeypatch):
    compared = []
    plain = ngram_join.true_links
    monkeypatch.setattr(ngram_join, "true_links", lambda pairs, *x: compared.append(pairs.count()) or plain(pairs, *x))
    monkeypatch.setattr(ngram_join, "boundary", lambda *_: -1)  # lists only
    rng = random.Random(2)
    passages = [" ".join(f"p{k}x{rng.randrange(10**6)}" for _ in range(60)) for k in range(20)]
    rows = []
    for k in range(24):
        own = [" ".join(f"o{k}y{rng.randrange(10**6)}" for _ in range(200)) for _ in range(20)]
        rows.append((k, " ".join(x for pair in zip(own, rng.sample(passages, 20), strict=True) for x in pair)))
    rows.append((100, rows[3][1].replace("o3y1", "changed")))
    assert joined(spark, rows) == brute(rows)
    assert sum(compared) < 24  # 276 pairs share all passages


@pytest.mark.parametrize("percent", [80, 90])
def test_bits_of_sets_of_any_size_differ_in_no_more_than_the_sets(percent):
    rule, rng = ngram_join.Rule(percent=percent), np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60_000).astype(np.uint64)
    sets = [np.unique(rng.choice(base, n, replace=False)) for n in (1, 40, 600, 2500, 2600, 9000, 50_000)]
    column = ngram_join._set_bits(sets, [rule.bits_of(len(s)) for s in sets])
    bits = ngram_join.Parities(column.take(pa.array(range(len(sets)))))
    assert len(set(bits.width.tolist())) > 2
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert bits.apart(np.array([i]), np.array([j]))[0] <= len(np.setxor1d(x, y))
