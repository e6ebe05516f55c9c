"""All registered queries."""

from vigipanel.plans import (  # noqa: F401  (importing registers)
    association_queries,
    incidence_queries,
    quality_queries,
    reconcile_queries,
    source_queries,
    spatial_queries,
    stock_queries,
)
from vigipanel.plans.registry import COMPARISON, QUERIES

__all__ = ["QUERIES", "COMPARISON"]
