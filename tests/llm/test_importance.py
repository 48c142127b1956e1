"""Importance resampling: CRC-32 of spans, the radix sort, and whole results against plain code."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from daytrail.llm import importance

DOCS = "doc_id long, text string, lang string, n_features long, weight long, score long, rank long, place long, bucket long"


def small(spark, rows):
    return spark.createDataFrame([(*r, "en", 7, 7, 7, 7, 7, 7) for r in rows], DOCS)


def test_crc_of_spans():
    texts = [b"", b"a", b"Abc", b"x" * 5000, "é中文".encode(), bytes(range(128))]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    got = importance.crc32s(raw, ends - [len(t) for t in texts], ends)
    assert got.tolist() == [zlib.crc32(bytes(b + 32 if 65 <= b <= 90 else b for b in t)) for t in texts]


def test_radix_sort_is_stable_and_whole(spark, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 4)
    monkeypatch.setattr(importance, "DIGIT", 9)
    rng = random.Random(3)
    rows = [(rng.choice([-5, 0, 3, 900, -(1 << 62)]), rng.choice([None, -7, 4, 1 << 40]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, i long").coalesce(3)
    got = sorted(importance.radix_ranked(df, ["a", "b"]).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(len(rows)))
    key = lambda r: (r[0], r[1] is None, r[1] or 0)
    assert [(r["a"], r["b"]) for r in got] == [r[:2] for r in sorted(rows, key=key)]
    same = importance.radix_ranked(df.withColumn("a", F.lit(1)), ["a"]).collect()
    assert sorted(r["place"] for r in same) == list(range(len(rows)))
    assert importance.radix_ranked(df.where("false"), ["a"]).collect() == []


def plain(docs, target):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    count = lambda texts: np.bincount([bucket(w) for t in texts for w in words(t)] or [0], minlength=10_000) * any(map(words, texts))
    s, t = count([d[1] for d in docs]), count(target)
    all_s, all_t = float(s.sum()), float(t.sum())
    gain = [math.floor(1000 * math.log((b + 1.0) * (all_s + 10_000) / ((a + 1.0) * (all_t + 10_000)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    out = []
    for i, text in docs:
        found = [gain[bucket(w)] for w in words(text)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranked = {r: k + 1 for k, r in enumerate(able[: len(able) * 10 // 100])}
    return out, ranked


def test_whole_results_on_odd_rows(spark):
    rng = random.Random(5)
    vocabulary = ["One", "two", "x1", "é", "中文", "z" * 300, "a-b"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 19, 20, 60])))) for i in range(-40, 60)]
    rows += [(200, None), (201, ""), (202, "... !!!"), (None, "two " * 40), (5, "two " * 30), (300, "two x1 " * 20_000)]
    target = ["two two é", None, "", "One x1"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, n long")
    got = [tuple(r) for r in importance.resample(small(spark, rows), bench).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    out, ranked = plain(rows, target)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted([(*r, ranked.get(r)) for r in out], key=key)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(small(spark, []), bench).collect() == []
    got = importance.resample(small(spark, [(1, "a b"), (2, None)]), bench).collect()
    assert sorted((r["doc_id"], r["n_features"], r["rank"]) for r in got) == [(1, 2, None), (2, 0, None)]
