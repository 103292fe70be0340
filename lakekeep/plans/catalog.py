"""All registered queries; importing the modules registers them."""

from lakekeep.plans import change_queries, metric_queries, storage_queries, usage_queries  # noqa: F401
from lakekeep.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
