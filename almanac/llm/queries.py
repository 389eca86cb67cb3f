"""The registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import chunks, classifier, divergence, fim, langid, mixing, neighbours, packing, rules, simhash, tokens, topk, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its text without repeated chunks, and how many words that took away."""
    docs = table(spark, sf_dir, "documents")
    out = chunks.dedup_substrings(docs)
    spans, first_ids = (F.col(c) for c in chunks.added_columns(docs))
    removed = F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", F.size(spans).alias("n_spans"), removed.cast("long").alias("removed_words"), first_ids.alias("first_ids"), spans.alias("spans"), "text")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packing.Pack()
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(p.tokenizer), p)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each output and of the text rebuilt from it."""
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fim.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {name: f for name, f in sorted(globals().items()) if name.startswith("op")}

OP10_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w, CAST(source_size AS DOUBLE) * 3 AS cap FROM by_source),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM by_source) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source, source_size, least(cap, (SELECT max(level) FROM levels) * w) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM targets),
ranked AS (
  SELECT s.doc_id, s.size, p.source, p.source_size, p.target, floor(ratio) AS copies, ratio - floor(ratio) AS share, p.target - floor(ratio) * p.source_size AS need,
    (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
odds AS (SELECT *, CASE WHEN share > 0 THEN (u / (1 - u)) * ((1 - share) / share) END AS q FROM ranked),
keyed AS (SELECT *, least(CAST(floor(q / (1 + q) * 1073741824.0::DOUBLE) AS BIGINT), 1073741823) AS rk FROM odds),
sums AS (SELECT source, rk, need, sum(size) AS size FROM keyed WHERE rk IS NOT NULL GROUP BY source, rk, need),
cum AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rk) AS upto FROM sums),
crossing AS (SELECT source, min(CASE WHEN upto > need THEN rk END) AS at FROM cum GROUP BY source),
cuts AS (
  SELECT c.source, CASE WHEN c.at IS NULL THEN 1073741824 WHEN x.upto - x.need < x.need - (x.upto - x.size) THEN c.at + 1 ELSE c.at END AS cut
  FROM crossing c LEFT JOIN cum x ON c.source IS NOT DISTINCT FROM x.source AND x.rk = c.at)
SELECT k.doc_id, k.size, k.source_size, k.target, CAST(k.size * (k.copies + CASE WHEN k.rk IS NOT NULL AND k.rk < c.cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM keyed k LEFT JOIN cuts c ON k.source IS NOT DISTINCT FROM c.source
"""

OP7_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v, true), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
grid AS (SELECT lang, source, term, coalesce(c, 0)::HUGEINT AS c FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
p AS (SELECT lang, source, term, c, 1 + (1000000000 * (c + 5)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM grid JOIN sizes USING (lang)),
whole AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM grid GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000 * (c + 5)) // (sum(c) OVER (PARTITION BY lang) + 5 * v) AS q FROM whole JOIN sizes USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(h, x, 8) AS BIGINT) FOR x IN [1, 9, 17, 25]] AS d FROM t),
cut AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

ORACLES = {"op7_top_k": OP7_SQL, "op10_mixing": OP10_SQL, "op12_source_divergence": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
