"""The registered queries of this subpackage, each over its whole table, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrail.llm import (
    decontamination,
    divergence,
    hamming,
    importance,
    language,
    licenses,
    line_dedup,
    mixing,
    ngram_join,
    sharding,
    site_style,
    suffix_dedup,
    token_ledger,
)
from daytrail.llm.columns import table
from daytrail.session import new_folder, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


@query("op1_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op6_hamming_topk",
    """
WITH c AS (
  SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i:
      CASE WHEN embedding[i] > 0 THEN (1::HUGEINT << (i - 1)::INTEGER) ELSE 0::HUGEINT END))::HUGEINT::UBIGINT AS code
  FROM embeddings WHERE len(embedding) = 64),
d AS (
  SELECT q.vec_id, n.vec_id AS neighbor_id, bit_count(xor(q.code, n.code))::BIGINT AS distance
  FROM c q CROSS JOIN c n WHERE q.vec_id % 50 = 0)
SELECT vec_id, CAST(ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank,
  neighbor_id, distance
FROM d QUALIFY rank <= 10
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op7_token_ledger")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ledger.ledger_of_documents(table(spark, sf_dir, "documents"), new_folder(spark))


@query("op8_site_style")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.main_text(table(spark, sf_dir, "pages"))


@query("op2_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learned(docs))


@query("op3_line_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), width=1)


@query(
    "op4_ngram_jaccard",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ 	-
]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
  FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS common
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 90 * (x.n + y.n - common)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT n.doc_id, n.n AS n_shingles, MIN(reach.b) AS component_id
FROM n JOIN reach ON reach.a = n.doc_id GROUP BY 1, 2
""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


@query("op5_slot_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), new_folder(spark))


@query(
    "op9_source_mix",
    r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    ('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, SUM(size)::BIGINT AS source_size,
    ((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, (SUM(source_size) OVER () - 3 * COALESCE(SUM(source_size) OVER (
        ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / SUM(weight) OVER (
        ORDER BY 3 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (
  SELECT source, source_size, LEAST(3.0::DOUBLE * source_size,
      weight * (SELECT MAX(level) FROM l WHERE level <= 3 * source_size / weight)) AS target
  FROM l),
b AS (
  SELECT source, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats
  FROM t),
r AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.repeats, b.target - b.repeats * b.source_size AS budget,
    d.h, d.source, SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
    SUM(d.size) OVER (PARTITION BY d.source, d.h) AS together
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source, source_size, target,
  repeats + taken AS times, (size * (repeats + taken))::BIGINT AS taken
FROM (SELECT *, CASE WHEN upto <= budget OR abs(upto - budget) < abs(upto - together - budget)
                     THEN 1 ELSE 0 END AS taken FROM r)
""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query(
    "op12_importance",
    r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
de AS (SELECT doc_id, unnest(w) AS w FROM dw),
be AS (
  SELECT unnest(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
x AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM de UNION SELECT w FROM be)),
b AS (
  SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT)),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM x CROSS JOIN tab),
ds AS (SELECT doc_id, bucket FROM de JOIN b USING (w)),
s AS (SELECT bucket, COUNT(*) AS s FROM ds GROUP BY 1),
t AS (SELECT bucket, COUNT(*) AS t FROM be JOIN b USING (w) GROUP BY 1),
g AS (
  SELECT bucket, floor(1000 * ln((COALESCE(t, 0) + 1)::DOUBLE * ((SELECT COALESCE(SUM(s), 0) FROM s) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT COALESCE(SUM(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
f AS (SELECT doc_id, COUNT(*) AS n, SUM(gain) AS total FROM ds JOIN g USING (bucket) GROUP BY 1),
w AS (
  SELECT d.doc_id, COALESCE(n, 0)::BIGINT AS n_features,
    CASE WHEN n IS NULL THEN 0 ELSE ((total - ((total % n) + n) % n) // n) END::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h
  FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id),
c AS (
  SELECT doc_id, n_features, weight,
    weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w),
r AS (
  SELECT doc_id, ROW_NUMBER() OVER (ORDER BY score DESC, doc_id) AS rank, COUNT(*) OVER () AS able
  FROM c WHERE n_features >= 20)
SELECT c.doc_id, n_features, weight, score, CASE WHEN rank <= able * 10 // 100 THEN rank END::BIGINT AS rank
FROM c LEFT JOIN r ON r.doc_id = c.doc_id
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op11_source_divergence",
    r"""
WITH d AS (
  SELECT ROW_NUMBER() OVER () AS r, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
    regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
e AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (
  SELECT lang, term, COUNT(*)::HUGEINT AS c FROM e GROUP BY 1, 2 HAVING COUNT(DISTINCT r) >= 30),
v AS (SELECT lang, COUNT(*)::HUGEINT AS v, SUM(c)::HUGEINT AS total FROM k GROUP BY 1),
c AS (
  SELECT e.lang, e.source, e.term, COUNT(*)::HUGEINT AS c
  FROM e JOIN k ON k.lang = e.lang AND k.term = e.term GROUP BY 1, 2, 3),
g AS (
  SELECT g.lang, g.source, COALESCE(SUM(c.c), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
f AS (
  SELECT g.lang, g.source, k.term, COALESCE(c.c, 0) AS c,
    1 + (1000000000::HUGEINT * (COALESCE(c.c, 0) + 5)) // (g.total + 5 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.c + 5)) // (v.total + 5 * v.v) AS q
  FROM g JOIN v ON v.lang = g.lang JOIN k ON k.lang = g.lang
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (
  SELECT a.lang, a.source, b.source AS item, SUM(abs(a.p - b.p)) AS value
  FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM f WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 50
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query(
    "op13_suffix_dedup",
    """
WITH d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, hex(encode(COALESCE(text, ''))) AS x FROM documents),
w AS (SELECT r, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM d),
h AS (SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM w),
m AS (SELECT r, i FROM h QUALIFY COUNT(*) OVER (PARTITION BY h) > 1),
n AS (SELECT r, i, CASE WHEN i - LAG(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM m),
g AS (SELECT r, i, SUM(new) OVER (PARTITION BY r ORDER BY i) AS g FROM n),
s AS (SELECT r, MIN(i) AS b, MAX(i) + 400 AS e FROM g GROUP BY r, g),
k AS (
  SELECT r, b, e, e - b AS gone, COALESCE(LAG(e) OVER (PARTITION BY r ORDER BY b), 0) AS was FROM s),
c AS (
  SELECT d.r, COUNT(*) AS spans, SUM(gone) AS gone,
    string_agg(substr(x, (2 * was + 1)::BIGINT, (2 * (b - was))::BIGINT), '' ORDER BY b) || substr(ANY_VALUE(x), (2 * MAX(e) + 1)::BIGINT) AS kept
  FROM k JOIN d ON d.r = k.r GROUP BY d.r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, COALESCE(gone, 0)::BIGINT AS n_removed,
  COALESCE(spans, 0)::BIGINT AS n_spans, sha256(unhex(COALESCE(kept, x))) AS kept_sha256
FROM d LEFT JOIN c ON c.r = d.r
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))
