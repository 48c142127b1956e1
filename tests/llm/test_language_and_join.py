"""Language network, n-gram join and the pipeline on small tables."""

import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from daytrail.llm import decontamination, language, ngram_join

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, root string, n long, sid string"


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    net = language.Network(["a", "b", "c"], seed=1)
    codes, target = rng.integers(97, 110, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1])

    def loss():
        p = language.softmax(net.forward(codes).astype(np.float64))
        return -np.log(p[:, target, np.arange(5)]).mean()

    for weights, grad in zip(net.parameters(), net.gradients(codes, target), strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in weights.shape)
            keep = weights[at]
            weights[at] = keep + 1e-2
            up = loss()
            weights[at] = keep - 1e-2
            down = loss()
            weights[at] = keep
            assert grad[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    net = language.learned(docs)
    odd = [(-1, None), (-2, ""), (-3, "12 !? \n"), (-4, "the of and " * 20000), (None, "Éauouon"), (-4, "the of and " * 20000)]
    all_docs = docs.union(spark.createDataFrame([(*r, None) for r in odd], "doc_id long, text string, lang string"))
    got = language.identify(all_docs.withColumn("score", F.lit("x")), net).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(got) == len(truth) + len(odd)
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in out]) > 0.97
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (-1, -2, -3))
    assert by_id[-4]["lang_pred"] == "en" and by_id[None]["lang_pred"] in truth.values()
    kept = language.accepted(all_docs, net)
    assert kept.columns == all_docs.columns and {r["doc_id"] for r in kept.collect()} >= set(truth) - {-1, -2, -3}
    empty = docs.where("false")
    assert language.learned(empty) is None and language.identify(empty, None).collect() == []
    assert language.identify(docs.limit(3), None).where("lang_pred <> 'und' OR score <> 0").count() == 0


def brute(rows):
    """Set size and smallest linked id by position of the row."""
    sets = []
    for _, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(
        (str(doc_id), len(sets[i]), str(least.get(find(i)) if sets[i] else doc_id)) for i, (doc_id, _) in enumerate(rows)
    )


def joined(spark, rows):
    docs = spark.createDataFrame([(*r, "en", "s", "r", 1, "x") for r in rows], DOCS)
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.join_documents(docs).collect())


@pytest.mark.parametrize("pairs_per_key,limit", [(4, None), (0, None), (4, -1), (4, 30)])
def test_groups_against_all_pairs(spark, monkeypatch, pairs_per_key, limit):
    monkeypatch.setattr(ngram_join, "PAIRS_PER_KEY", pairs_per_key)
    if limit is not None:
        monkeypatch.setattr(ngram_join, "boundary", lambda *_: limit)
    rows = []
    for size, step in ((9, 3), (25, 7), (60, 4), (300, 23), (900, 40)):
        base = [f"s{size}w{i}" for i in range(size + 2)]
        for k in range(14):  # a chain: each text differs from the next in a place or two
            text = [f"x{k}" if i % step == 0 and i // step == k else w for i, w in enumerate(base)]
            rows.append((len(rows) + 5, " ".join(text if k % 2 else text[: size + 2 - size // 30])))
    rows += [(900, rows[20][1].upper()), (901, None), (902, ""), (903, "One two"), (904, "one TWO"), (905, "one"), (None, "One two")]
    rows += [(906, " ".join(f"y{i}" for i in range(11))), (907, " ".join(f"y{i}" for i in range(12))), (906, "z " * 40)]
    assert joined(spark, rows) == brute(rows)


def test_join_of_nothing_and_one_of_each(spark):
    empty = spark.createDataFrame([], DOCS)
    assert ngram_join.join_documents(empty).collect() == []
    long_text = " ".join(f"w{i}" for i in range(200))
    rows = [(3, long_text), (1, long_text + " more"), (2, "other text of its own"), (2, "other text of its own"), (4, None), (5, None)]
    docs = spark.createDataFrame([(*r, "en", "s", "r", 1, "x") for r in rows], DOCS)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5]


def test_stages_on_a_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sf = "/root/testdata/sf0.01"
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "decontaminate", "mix_sources", "shard"
    ]
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert kept[-1].columns == docs.columns
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").collect()) for d in kept]
    assert set(ids[1]) >= {r["doc_id"] for r in docs.where(F.length("text") > 200).select("doc_id").collect()}
    groups = {i: g for i, _, g in ((r["doc_id"], 0, r["component_id"]) for r in ngram_join.join_documents(kept[1], corpus_pipeline.NEAR).collect())}
    assert ids[2] == sorted(set(groups.values()))
    marks = decontamination.contaminated(kept[2], spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert ids[3] == sorted(r["doc_id"] for r in marks.where("NOT contaminated").collect())
    assert len(ids[4]) == len(ids[5]) and set(ids[4]) <= set(ids[3])


def test_a_pipeline_over_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
