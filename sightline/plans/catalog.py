"""All registered queries over the reference tables."""

from sightline.plans import curation_queries, ranking_queries, retrieval_queries, scalar_queries, series_queries, source_queries, training_queries, workflow_queries  # noqa: F401
from sightline.plans.registry import ORACLE_SQL, QUERIES, SLOW_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "SLOW_SQL"]
