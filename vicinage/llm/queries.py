"""The thin queries over whole tables: each applies its operator with production parameters and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm import bpe, html, neardup, packing, pii, quality, secrets, toxicity, vectors
from vicinage.llm.common import Scratch, table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.top_k(spark, rows, rows.where(F.col("vec_id") % 50 == 0), k=5, scale=256.0)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), Scratch(spark, "pii").save)
    base = F.filter("spans", lambda x: x["kind"] < len(pii.BASE))
    kinds = F.transform("spans", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.BASE)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), digests=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(spark, table(spark, sf_dir, "documents"), width=2, percent=80)


def op7_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark, table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op1_topk": op1_topk, "op2_html": op2_html, "op3_pii": op3_pii, "op4_secrets": op4_secrets, "op5_quality": op5_quality, "op6_minhash": op6_minhash, "op7_cosine": op7_cosine, "op8_bpe": op8_bpe, "op9_toxicity": op9_toxicity, "op10_packing": op10_packing}

ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op6_minhash": """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
p AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
c AS (
  WITH RECURSIVE r(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach)
  SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON c.id = s.doc_id
""",
    "op7_cosine": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.q, b.q) >= 0.9),
c AS (
  WITH RECURSIVE w(id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT w.id, e.b FROM w JOIN e ON e.a = w.reach)
  SELECT id, min(reach) AS component_id FROM w GROUP BY id)
SELECT t.vec_id, (SELECT count(*) FROM e WHERE e.a = t.vec_id) AS n_links, c.component_id, t.vec_id = c.component_id AS kept
FROM embeddings t JOIN c ON c.id = t.vec_id
""",
}
