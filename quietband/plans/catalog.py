"""All registered queries."""

from quietband.plans import catalog_scores, catalog_tables, catalog_vectors  # noqa: F401
from quietband.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
