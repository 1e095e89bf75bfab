"""All registered queries."""

from triagelake.plans import (  # noqa: F401
    article_queries,
    routing_queries,
    state_queries,
    text_queries,
    vector_queries,
)
from triagelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
