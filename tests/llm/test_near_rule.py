"""The near-duplicate stage: 5-word shingles from 0.8 on, against all pairs of documents."""

import itertools
import re

import pytest

import corpus_pipeline
from daytrail.llm import ngram_join

DOCS = "doc_id long, text string, lang string"


def kept_by_pairs(rows, width, percent):
    """The smallest id of each group, from every pair of rows (ids are unique)."""
    sets, least = {}, {i: i for i, _ in rows}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            low, high = sorted((find(i), find(j)))
            least[high] = low
    return sorted({find(i) for i in least})


@pytest.mark.parametrize("limit", [None, -1, 30])
def test_the_stage_against_all_pairs(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(ngram_join, "boundary", lambda *_: limit)
    rows = []
    for size in (4, 5, 9, 24, 60, 300, 900):
        base = [f"s{size}w{i}" for i in range(size + 4)]
        for k in range(6):  # the n-th copy has n edited words in a place of its own, some are shorter
            text = list(base)
            for e in range(k * size // 90):
                text[(k * 37 + e * 11) % len(text)] = f"x{k}e{e}"
            rows.append((len(rows) + 5, " ".join(text[: len(text) - (k % 3) * size // 20])))
        rows += [(500 + size, " ".join(base[:-1])), (1500 + size, " ".join(f"y{w}" for w in base[:4])), (2500 + size, None)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], DOCS)
    expected = kept_by_pairs(rows, 5, 80)
    assert len(expected) < len(kept_by_pairs(rows, 3, 90))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == expected
