"""Queries of the operators on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import hard_negatives
from cohortspark.llm.registry import query, table

NEGATIVES_SQL = f"""
WITH held AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::double)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.r, a.vec_id AS anchor_id, x.vec_id AS other, a.label = x.label AS alike, list_inner_product(a.v, x.v)::bigint AS score
    FROM held a JOIN held x ON a.r <> x.r WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, other NULLS LAST) AS place FROM pairs WHERE alike
    QUALIFY place <= {hard_negatives.POSITIVES}),
met AS (
    SELECT p.r, p.place, p.anchor_id, p.other AS positive_id, p.score AS positive_score, n.other AS negative_id, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.r, p.place ORDER BY n.score DESC, n.other NULLS LAST)::int AS rank
    FROM positives p JOIN pairs n ON p.r = n.r AND NOT n.alike
    WHERE {hard_negatives.LOW} * p.score <= 100 * n.score AND 100 * n.score <= {hard_negatives.HIGH} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM met WHERE rank <= {hard_negatives.NEGATIVES}
"""


@query(NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hardest negatives of every anchor and positive, some labels shifted first."""
    vectors = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.select("vec_id", shifted.alias("label"), "embedding")
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0, "vec_id", "label", "embedding").drop("place")
