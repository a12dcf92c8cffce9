"""All queries and their check SQL."""

from plotgrid.plans import filter_queries, join_queries, linework_queries, predicate_queries, table_queries, tile_queries  # noqa: F401  (register their queries)
from plotgrid.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
