"""The divergence audit against plain counts, with odd rows and large numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from daytrail.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, term string, value long, idx long, n long"


def small(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 1, 1) for r in rows], DOCS)


def plain(rows, least, top=50):
    found, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        found[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def share(counts, kept=kept, v=v):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * v) for t in kept}

        p = share(found[lang, source])
        q = share(sum((found[g] for g in groups if g[0] == lang), Counter()))
        pairs = [
            (sum(abs(p[t] - x) for t, x in share(found[lang, s]).items()), s)
            for g, s in groups if g == lang and s != source
        ]
        terms = [(p[t] - q[t], t) for t in kept if found[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(items)]
    return sorted(out)


def audited(spark, rows, least, top=50):
    got = divergence.audit(small(spark, rows).repartition(3), least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in got.collect())


def test_odd_rows_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 16)
    rng = random.Random(9)
    stems = ["a", "ab", "abcd", "abcde", "abcdefgh", "abcdefghi", "é", "éé中", "x" * 40, "x" * 41, "x" * 33 + "y", "Zz"]
    rows = []
    for i in range(150):
        words = rng.choices(stems, weights=range(1, 13), k=rng.randint(0, 9)) + [f"only{i}", f"abcdefgh{i}"]
        rows.append((i, " ".join(words) + "1abc-AB", rng.choice(["en", "de", None]), rng.choice(["s", "t", "", None, "u"])))
    rows += [rows[3], rows[3], (None, None, "fr", None), (7, "", "fr", "s"), (8, "lone", "it", "s"), (9, "the " * 50_000, "en", "t")]
    for least in (1, 4, 60):
        assert audited(spark, rows, least, 3) == plain(rows, least, 3)


def test_a_filter_that_is_full_changes_nothing(spark, monkeypatch):
    rows = [(i, " ".join(f"prefix{'z' * (i % 7)}{j}" for j in range(i % 5)), "en", "ab"[i % 2]) for i in range(60)]
    monkeypatch.setattr(divergence, "FILTER_BITS", 64)
    assert audited(spark, rows, 3) == plain(rows, 3)


def test_no_rows(spark):
    assert audited(spark, [], 1) == []


def test_shares_are_exact(spark):
    rows = [(c, n, v) for c, n in ((0, 0), (3, 9), (10**12, 10**13), (10**15, 10**15), (1, 9 * 10**15)) for v in (1, 7, 10**7)]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    got = df.select("c", "n", "v", divergence.scaled_share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in rows]
    assert np.all([divergence._hash("en") != divergence._hash("de")])
