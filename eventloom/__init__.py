"""Event-graph analytics on Spark: entities, events and tags as DataFrames, and the queries over them."""

from .graph import EventGraph

__all__ = ["EventGraph"]
