"""All registered queries."""

from . import catalog_graph, catalog_learning, catalog_more, catalog_rest, catalog_streams  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
