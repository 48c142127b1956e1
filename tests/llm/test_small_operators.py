"""Sharding, mixing, search, tiling, pages, licences and the ledger on small tables against plain code."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from daytrail.llm import decontamination, hamming, licenses, mixing, sharding, site_style, token_ledger

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, size string, h long, row string, slot int, key string"
ROWS = [
    (1, "one two three", "b", "en"), (2, None, "b", None), (3, "", None, "fr"), (None, "x", None, "fr"),
    (4, "one two three", "a", "en"), (4, "one two three", "a", "en"), (5, "w " * 5000, "c", "de"),
]


def small(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "s", 7, "r", 1, "k") for r in rows], DOCS)


# --- sharding ----------------------------------------------------------------------------


def check_shards(docs, got, shards=16):
    assert len(got) == len(docs)
    loads, places = [0] * shards, [[] for _ in range(shards)]
    for r in got:
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places)
    text = {d["doc_id"]: d["text"] for d in docs}
    for r in got:
        t = text[r["doc_id"]]
        assert r["size"] == (0 if t is None else len(t.encode())) + 1
        assert r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
    return loads


def test_shards_of_a_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.shard_documents(docs, str(tmp_path / "m")).collect()
    loads = check_shards(docs.collect(), got)
    largest = max(r["size"] for r in got)
    assert max(loads) - min(loads) <= largest


def test_shards_of_odd_rows(spark, tmp_path):
    check_shards(small(spark).collect(), sharding.shard_documents(small(spark), str(tmp_path / "m")).collect())
    assert sharding.shard_documents(small(spark, []), str(tmp_path / "e")).collect() == []


def test_an_edit_moves_only_what_is_too_much(spark):
    current = spark.createDataFrame([(i, i % 4) for i in range(64)], "vslot int, shard int")
    even = spark.createDataFrame([(i, 10, 1) for i in range(64)], "vslot int, bytes long, rows long")
    assert sharding.edit_map(even, current, 4).where("moved").count() == 0
    hot = even.withColumn("bytes", F.when(F.col("vslot") == 0, 100).otherwise(10).cast("long"))
    edited = sharding.edit_map(hot, current, 4)
    loads = {r["shard"]: r["b"] for r in edited.join(hot, "vslot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    assert max(loads.values()) - min(loads.values()) <= 10 * 2 and 0 < edited.where("moved").count() < 12
    grown = sharding.edit_map(even, current, 5)
    assert set(r["shard"] for r in grown.collect()) == set(range(5))


# --- mixing ------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def test_mix_of_a_table_and_of_odd_rows(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), small(spark)):
        rows = mixing.mix(docs).collect()
        assert len(rows) == docs.count()
        sizes = {}
        for r in rows:
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        expected = plain_targets(sizes)
        for source, target in expected.items():
            mine = [r for r in rows if r["source"] == source]
            assert all(r["target"] == pytest.approx(target) and r["source_size"] == sizes[source] for r in mine)
            assert all(r["taken"] in [k * r["size"] for k in range(4)] for r in mine)
            assert abs(sum(r["taken"] for r in mine) - target) <= 2 * max(r["size"] for r in mine)
        assert mixing.mixed_documents(docs).count() == sum(r["times"] for r in rows)
        assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(small(spark, [])).collect() == []


# --- search ------------------------------------------------------------------------------


@pytest.mark.parametrize("block,group", [(1 << 13, 128), (8, 2)])
def test_nearest_codes(spark, monkeypatch, block, group):
    monkeypatch.setattr(hamming, "BLOCK", block)
    monkeypatch.setattr(hamming, "GROUP", group)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).tolist(), "c") for i in range(60)]
    rows += [(100 + i, rows[3][1], "c") for i in range(30)] + [(200, None, "c"), (201, [1.0], "c"), (None, rows[0][1], "c")]
    rows += [(202, [None] + [1.0] * 11, "c")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string")
    got = hamming.nearest(vectors, F.col("vec_id") % 10 == 0, k=5, bits=12)
    whole = [(i, np.array(v) > 0) for i, v, _ in rows if v is not None and len(v) == 12 and None not in v]
    for query, v in whole:
        if query is None or query % 10:
            continue
        best = sorted((int((v != w).sum()), i is None, i or 0) for i, w in whole)[:5]
        mine = sorted((r["rank"], r["distance"], r["neighbor_id"]) for r in got.where(F.col("vec_id") == query).collect())
        assert [(d, i is None, i or 0) for _, d, i in mine] == best
    assert hamming.nearest(vectors.where("false"), F.col("vec_id") % 10 == 0).collect() == []


# --- tiling ------------------------------------------------------------------------------


def plain_tiles(text, item, least):
    """Longest common run of free words, over all places, again and again."""
    free_t, free_i, tiles = [True] * len(text), [True] * len(item), []
    while True:
        best = None
        for i, j in itertools.product(range(len(item)), range(len(text))):
            n = 0
            while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and free_i[i + n] and free_t[j + n]:
                n += 1
            if n >= least and (best is None or (-n, i, j) < best):
                best = (-n, i, j)
        if best is None:
            return tiles
        n, i, j = -best[0], *best[1:]
        free_i[i : i + n] = free_t[j : j + n] = [False] * n
        tiles.append((n, i, j))


def test_tiles_against_all_places():
    rng = random.Random(3)
    for _ in range(60):
        text = [rng.randint(1, 4) for _ in range(rng.randint(0, 30))]
        item = [rng.randint(1, 4) for _ in range(rng.randint(0, 20))]
        assert decontamination.greedy_tiles(text, item, 3) == plain_tiles(text, item, 3)


def test_moved_sentences_are_found(spark):
    first, second = "Alpha beta gamma delta epsilon zeta eta.", "One two three four five six seven eight."
    rows = [
        (1, f"Intro. {first} {second} End."), (2, f"{second.upper()} some words between {first}"), (3, first), (4, None), (5, ""),
        (6, "nothing of it"), (7, f"{second} x {first}"), (7, f"{second} x {first}"), (None, f"{first} {second}"),
    ]
    docs = spark.createDataFrame([(*r, "k", "w") for r in rows], "doc_id long, text string, key string, words string")
    items = spark.createDataFrame([(1, f"{first} {second}"), (2, "too short"), (3, None), (None, None)], "item_id long, text string")
    got = decontamination.contaminated(docs, items).collect()
    assert sorted(str(r["doc_id"]) for r in got if r["contaminated"]) == ["1", "2", "7", "7", "None"]
    assert all(r["item_id"] == 1 and r["share"] == 1.0 for r in got if r["contaminated"]) and len(got) == len(rows)
    kept = decontamination.clean_documents(docs, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == docs.columns
    assert decontamination.contaminated(docs, items.where("false")).where("contaminated").count() == 0
    assert decontamination.contaminated(docs.where("false"), items).collect() == []


# --- pages -------------------------------------------------------------------------------


def test_page_parts(spark):
    rows = [
        (1, "http://a.org/1", "<body><nav><ul><li>Menu</ul></nav><div class='main-col sidebar-left'><article><h1>T&amp;t</h1><p>a <b>b</b>c"
            "<p>d<br>e<aside>no</aside><div class=comments><p>hm</div></article></div><footer>f</footer>"),
        (2, "http://a.org/2", None), (3, None, "plain &lt;text&gt; of\n a  page"), (3, "x", ""),
        (4, "http://a.org/4", "<script>var a='<p>no</p>'</script><p>yes &#233;</p><!-- <p>no</p> --><form>no</form><p>cut &amp"),
    ]
    pages = spark.createDataFrame([(*r, "h", "t") for r in rows], "page_id long, url string, html string, host string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in site_style.main_text(pages).collect())
    assert got == [(1, "T&t\na bc\nd e", 12), (2, "", 0), (3, "", 0), (3, "plain <text> of a page", 22), (4, "yes é\ncut &", 11)]
    assert site_style.main_text(pages.where("false")).collect() == []


def test_what_all_pages_share_is_cut(spark):
    rows = [
        (i, f"http://b.org/{i}", f"<div id=x><div class=top><p>Same words everywhere</p></div><div class=body><p>Story {i} of many</p></div></div>")
        for i in range(12)
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in site_style.main_text(pages).collect()} == {f"Story {i} of many" for i in range(12)}
    tree = {r["path"]: r for r in site_style.style_tree(site_style.parse(pages)).collect()}
    assert tree["/div/div.top/p"]["importance"] == 0 and tree["/div/div.body/p"]["importance"] == pytest.approx(1)


# --- licences ----------------------------------------------------------------------------


def test_licences_of_small_texts(spark):
    rows = [
        (1, "Some story of a town.\nReleased under the MIT License.\nMore of it."), (2, None), (3, ""), (4, "license"),
        (5, "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3."),
        (6, "The public library of the general is licensed to sell tea on the second floor."), (1, "Licensed under CC BY-NC 4.0."),
    ]
    docs = spark.createDataFrame([(*r, "f", "p") for r in rows], "doc_id long, text string, family string, pairs string")
    got = sorted((r["doc_id"], r["licenses"] or "") for r in licenses.scan(docs).collect())
    assert got == [(1, "CC-BY-NC"), (1, "MIT"), (2, ""), (3, ""), (4, ""), (5, "Apache-2.0,GPL"), (6, "")]
    assert licenses.scan(docs.where("false")).collect() == []


# --- token ledger ------------------------------------------------------------------------


def totals(rows):
    out = {}
    for source, lang, tokenizer, n in rows:
        d, t = out.get((source, lang, tokenizer), (0, 0))
        out[(source, lang, tokenizer)] = (d + 1, t + n)
    return out


def test_ledger_of_a_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, expected = {}, []
    one = token_ledger.encoding(token_ledger.VOCABULARIES, "byte_bpe_50k")
    many = token_ledger.encoding(token_ledger.VOCABULARIES, "byte_bpe_multi_50k")
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        if first.setdefault(r["text"], r["doc_id"]) == r["doc_id"]:
            name, coder = ("bpe-1", one) if r["lang"] == "en" else ("bpe-2", many)
            expected.append((r["source"], r["lang"], name, len(coder.encode_ordinary(r["text"]))))
    got = token_ledger.ledger_of_documents(docs, str(tmp_path)).collect()
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in got} == totals(expected)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    coder = token_ledger.encoding(token_ledger.VOCABULARIES, "byte_bpe_50k")
    text = "Ein Wort, it's  two\n\n spaces 12 km élan " * 50 + "x" * 300
    whole = len(coder.encode_ordinary(text))
    for size in (16, 50, 333):
        monkeypatch.setattr(token_ledger, "PIECE", size)
        assert token_ledger.count_text(coder, text) == whole


def test_batches_are_idempotent(spark, tmp_path):
    schema = "doc_id long, source string, lang string, tokenizer string, n_tokens long"
    ledger = token_ledger.Ledger(spark, str(tmp_path))
    rows = [(1, "a", "en", "t", 5), (2, "a", None, "t", 7), (2, "a", None, "t", 6), (None, None, "en", "t", 1)]
    assert ledger.commit("x", [], spark.createDataFrame(rows, schema))
    assert not ledger.commit("x", [], spark.createDataFrame([(9, "z", "z", "t", 9)], schema))
    as_dict = lambda b: {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in ledger.totals(b).collect()}
    assert as_dict("x") == {("a", "en"): (1, 5), ("a", None): (1, 7), (None, "en"): (1, 1)}
    # A batch that broke off after its signed rows is written again as a whole.
    change = spark.createDataFrame([(1, "b", "en", "t", 8), (2, None, None, "t", None), (77, None, None, "t", None)], schema)
    spark.createDataFrame([], ledger.signed_schema).write.parquet(f"{tmp_path}/signed/batch=y")
    with pytest.raises(ValueError):
        ledger.totals("y")
    assert ledger.commit("y", ["x"], change)
    assert as_dict("y") == {("b", "en"): (1, 8), (None, "en"): (1, 1)}
    assert ledger.commit("z", ["x", "y"], spark.createDataFrame([], schema)) and as_dict("z") == as_dict("y")
