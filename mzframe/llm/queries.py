"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mzframe.llm import byte_bpe, common, license_scan, mtree, multi_index, near_dedup, pii, raking, url_filter, warc, weak_labels
from mzframe.llm.license_templates import SHORT_TEMPLATES, TEMPLATES

#: Fixed by the queries' contract.
URL_RULES = [
    url_filter.rule("allow", "com/"),
    url_filter.rule("block", "example.com/en/"),
    url_filter.rule("allow", "www.example.com/en/"),
    url_filter.rule("block", "net/es/"),
    url_filter.rule("block", "net/fr/"),
]


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), TEMPLATES | SHORT_TEMPLATES, threshold=0.8)


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.93)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path, pattern = tokenizer()
    return byte_bpe.encode(docs, byte_bpe.load_ranks(spark, path), pattern, byte_bpe.digests, byte_bpe.DIGESTS)


def op4_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return weak_labels.classify(docs, weak_labels.fit(docs))


#: Powers that temper the natural shares.
MIX_TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def op5_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = raking.describe(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    described = common.materialize(described.select("doc_id", "source_group", "lang_group", "topic_group", "n_tokens"), "described")
    mixed = raking.sample(described, MIX_TARGETS, budget_share=0.8)
    rounded = (F.round(c, 6).alias(c) for c in ("factor", "probability"))
    return mixed.select("doc_id", "source_group", "lang_group", "topic_group", "n_tokens", *rounded, "sampled")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge(pages, URL_RULES, url_filter.fit(pages))


def op7_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, scale=256, every=50)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = common.scratch_path(spark, "warc")
    warc.write_archives(pages, path)
    records = common.materialize(warc.read_archives(spark, path, with_payload=False), "records")
    captures = warc.transactions(records)
    refers_to = F.col("metadata.refers_to_key").cast("long").alias("refers_to")
    return captures.select(F.col("metadata.capture_key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers_to, "target_uri")


def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), threshold=0.8)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_multi_index": op2_multi_index,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_weak_labels": op4_weak_labels,
    "op5_raking": op5_raking,
    "op6_url_filter": op6_url_filter,
    "op7_mtree": op7_mtree,
    "op8_warc": op8_warc,
    "op9_weighted_minhash": op9_weighted_minhash,
    "op10_pii": op10_pii,
}
#: Brute force over the same rows.
ORACLE_SQL = {
    "op2_multi_index": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings
), good AS (
  SELECT vec_id, label, list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y)))) AS u FROM v
  WHERE label IS NOT NULL AND vec IS NOT NULL AND list_count(vec) = len(vec) AND len(vec) > 0
    AND list_bool_and(list_transform(vec, lambda x: isfinite(x))) AND list_sum(list_transform(vec, lambda y: y * y)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.u) = len(b.u)
  WHERE list_dot_product(a.u, b.u) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v JOIN low ON low.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    "op5_raking": r"""
WITH RECURSIVE d AS (
  SELECT doc_id,
    CASE WHEN trim(source) <> '' THEN source ELSE 'unknown' END AS source_group,
    CASE WHEN trim(lang) <> '' THEN lang ELSE 'unknown' END AS lang_group,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty'
      WHEN (length(text) - length(translate(text, '|{}<>=;', ''))) * 30 > length(text) THEN 'table'
      WHEN (length(text) - length(translate(text, '#$%&*@^~', ''))) * 20 > length(text) THEN 'symbols'
      WHEN (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) * 4 > length(text) THEN 'capitals'
      WHEN length(text) < 1000 THEN 'note' WHEN length(text) < 5000 THEN 'article' ELSE 'book' END AS topic_group,
    coalesce(len(regexp_extract_all(text, '\S+')), 0)::BIGINT AS n_tokens
  FROM documents
), c AS (
  SELECT source_group, lang_group, topic_group, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0
), gs AS (SELECT source_group, pow(sum(tokens), 0.5) AS raw FROM c GROUP BY 1),
gl AS (SELECT lang_group, pow(sum(tokens), 0.7) AS raw FROM c GROUP BY 1),
gt AS (SELECT topic_group, pow(sum(tokens), 0.8) AS raw FROM c GROUP BY 1),
goals AS (
  SELECT c.*, gs.raw / (SELECT sum(raw) FROM gs) AS ps, gl.raw / (SELECT sum(raw) FROM gl) AS pl, gt.raw / (SELECT sum(raw) FROM gt) AS pt
  FROM c JOIN gs USING (source_group) JOIN gl USING (lang_group) JOIN gt USING (topic_group)
), fit AS (
  SELECT 0 AS i, *, tokens::DOUBLE AS share FROM goals
  UNION ALL
  SELECT i + 1, source_group, lang_group, topic_group, tokens, ps, pl, pt, y * pt / sum(y) OVER (PARTITION BY topic_group)
  FROM (SELECT *, x * pl / sum(x) OVER (PARTITION BY lang_group) AS y
    FROM (SELECT *, share * ps / sum(share) OVER (PARTITION BY source_group) AS x FROM fit WHERE i < 8))
), f AS (
  SELECT source_group, lang_group, topic_group, tokens, share * (SELECT sum(tokens) FROM c) / tokens AS factor FROM fit WHERE i = 8
), o AS (
  SELECT *, coalesce(sum(tokens) OVER w, 0) AS before, sum(tokens * factor) OVER () - coalesce(sum(tokens * factor) OVER w, 0) AS rest
  FROM f WINDOW w AS (ORDER BY factor DESC, source_group, lang_group, topic_group ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), rate AS (
  SELECT (0.8 * (SELECT sum(tokens) FROM c) - before) / rest AS rate FROM o
  WHERE factor * (0.8 * (SELECT sum(tokens) FROM c) - before) / rest < 1 ORDER BY factor DESC LIMIT 1
)
SELECT doc_id, source_group, lang_group, topic_group, n_tokens, round(coalesce(factor, 1), 6) AS factor,
  round(coalesce(least(1, factor * (SELECT rate FROM rate)), 0.8), 6) AS probability,
  ('0x' || substr(md5('11/' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < coalesce(least(1, factor * (SELECT rate FROM rate)), 0.8) AS sampled
FROM d LEFT JOIN f USING (source_group, lang_group, topic_group)""",
    "op7_mtree": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, y.vec_id, list_dot_product(q.vec, y.vec)::BIGINT AS score
  FROM v q JOIN v y ON q.vec_id % 50 = 0 AND q.vec_id <> y.vec_id AND len(q.vec) = len(y.vec)
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
}
