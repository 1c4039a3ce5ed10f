"""All queries of the engine."""

from edgeloom.plans import dataset_queries, edge_queries, extra_queries, graph_queries, score_queries, selector_queries, structure_queries  # noqa: F401
from edgeloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
