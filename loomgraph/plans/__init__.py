"""Named queries over the driver tables and their SQL."""

from .graph_queries import queries
from .graph_sql import oracle_sql

__all__ = ["oracle_sql", "queries"]
