"""All check queries, in inventory order."""

from treespark.plans import queries_batches, queries_scores, queries_tables, queries_trees  # noqa: F401
from treespark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
