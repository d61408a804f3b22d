"""All queries of the engine and their oracles."""

from __future__ import annotations

from . import analytic_queries, chain_queries, delta_queries, index_queries, lookup_queries, more_queries, object_queries, tree_queries, write_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
