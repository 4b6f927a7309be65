"""Clean training data from raw documents: five stages, each over all that the one before kept.

Every stage judges a null text like an empty one and repeated rows alike, takes texts of any length
whole, keeps columns it does not know, and gives an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm import decontaminate, mixing, quality_rules, simhash, toxicity
from cohortspark.llm.registry import query, table
from cohortspark.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs certified for their language; a text without words goes."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic; a text without words is not."""
    return toxicity.keep_harmless(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: three-word shingles, at most three differing bits.

    Texts without words are copies of each other, and so are equal rows.
    """
    return simhash.keep_one(docs, shingle=simhash.SHINGLE, radius=simhash.RADIUS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs; one without words has none."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of training text in output order, sources mixed to their targets; texts without words give nothing."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("toxicity", harmless),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("source_mixing", mix),
]

# The verdicts rest on trained classifiers, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


query(ORACLE_SQL, "pipeline")(run)
