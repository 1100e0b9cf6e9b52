"""The registered queries of this package and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, forest, lines, mixing, pii, quality, sharding, simhash, tokens, toxicity
from .common import read


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), radius=4, width=4)
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(read(spark, sf_dir, "embeddings"), every=100, k=10)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_assignments(read(spark, sf_dir, "documents"))


def op7_toxicity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.repeated_units(read(spark, sf_dir, "documents"))
    span = F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"], s["kept_in"]))
    return found.select("doc_id", "n_units", "n_removed", "removed_chars", F.array_join(span, ",").alias("removed"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_prefix_forest,
        op3_token_counts,
        op4_quality_classifier,
        op5_source_mixing,
        op6_hilbert_sharding,
        op7_toxicity_segments,
        op8_line_dedup,
        op9_personal_data,
        op10_decontamination,
        pipeline,
    )
}

OP10 = r"""
WITH d AS (
  SELECT ROW_NUMBER() OVER () AS r, doc_id,
         COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT item_id, w, LEAST(8, len(w)) AS n, UNNEST(range(1, len(w) - LEAST(8, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
g AS (
  SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT r, w, n, UNNEST(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
m AS (SELECT r, k, n, item_id FROM g JOIN p USING (n, g)),
h AS (SELECT r, COUNT(DISTINCT x) AS n_hit FROM (SELECT r, UNNEST(range(k, k + n)) AS x FROM m) GROUP BY r),
c AS (SELECT r, COUNT(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s COLLATE C)) AS items_sha256
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
       COALESCE(items_sha256, sha256('')) AS items_sha256, COALESCE(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN c USING (r)
"""

ORACLE = {"op5_source_mixing": mixing.ORACLE, "op10_decontamination": OP10}
