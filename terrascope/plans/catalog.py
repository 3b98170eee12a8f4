"""All registered queries; importing a query module registers its entries."""

from terrascope.plans import embedding_queries, evaluation_queries, frame_queries, geometry_queries, region_queries, stateful_queries  # noqa: F401
from terrascope.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
