"""The registered queries over the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_digests
from .common import read
from .lattice import lattice_scores
from .licences import licence_scan
from .licences import oracle as licence_sql
from .packing import best_fit_packing
from .pii import oracle as pii_sql
from .pii import pii_scan
from .sharding import feistel_shards
from .simhash import simhash_components
from .topk import top_k
from .toxicity import toxic_documents
from .vectors import near_vectors


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path
    return best_fit_packing(docs, path("byte_bpe_50k.tiktoken"), path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(read(spark, sf_dir, "documents"))


def op5_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan(read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards(read(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_best_fit_packing, op3_embedding_near_dedup, op4_licence_scan, op5_lattice_likelihood, op6_simhash_near_dedup, op7_byte_bpe, op8_personal_data, op9_sharding, op10_exact_topk)}

OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT v.vec_id,
  (SELECT count(*) FROM links WHERE u = v.vec_id) AS n_links,
  least(v.vec_id, coalesce((SELECT min(r.v) FROM reach r WHERE r.u = v.vec_id), v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce((SELECT min(r.v) FROM reach r WHERE r.u = v.vec_id), v.vec_id)) AS kept
FROM v
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE_SQL = {"op3_embedding_near_dedup": OP3_SQL, "op4_licence_scan": licence_sql(), "op8_personal_data": pii_sql(), "op10_exact_topk": OP10_SQL}
