"""Notices inside long lines are found, wherever they stand."""

from daytrail.llm import licenses


def test_notices_inside_long_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = [w for r in docs.where("length(text) > 400").orderBy("doc_id").limit(40).collect() for w in r["text"].split()]
    notices = [("MIT", licenses.TEMPLATES["MIT"][0]), ("MIT", licenses.TEMPLATES["MIT"][3]), ("GPL", licenses.TEMPLATES["GPL"][0]),
               ("Apache-2.0", licenses.TEMPLATES["Apache-2.0"][2]), ("CC-BY-NC", licenses.TEMPLATES["CC-BY-NC"][1])]
    rows, expected = [], {}
    for k, (family, notice) in enumerate(notices):
        for i, (before, after) in enumerate(((100, 100), (0, 200), (200, 0), (47, 160), (1500, 1500), (10, 15))):
            doc_id = -1 - 10 * k - i
            rest = words[100 * k : 100 * k + before], words[100 * k + before : 100 * k + before + after]
            rows.append((doc_id, " ".join([*rest[0], notice, *rest[1]])))
            expected[doc_id] = family
    rows.append((-100, " ".join(words[:3000])))
    all_docs = docs.union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(all_docs).where("doc_id < 0").collect()}
    assert got == expected | {-100: None}
