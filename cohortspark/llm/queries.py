"""All queries of this subpackage and their SQL."""

from cohortspark.llm import corpus_queries, pipeline, quality_queries, record_queries, vector_queries, web_queries
from cohortspark.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus_queries", "pipeline", "quality_queries", "record_queries", "vector_queries", "web_queries"]
