"""Worked queries over the test tables."""

from cohortspark.plans import booster_queries, builder_queries, cohort_queries, model_queries, stat_queries
from cohortspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "booster_queries", "builder_queries", "cohort_queries", "model_queries", "stat_queries"]
