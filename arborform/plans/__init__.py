from .catalog import QUERIES
from .oracle import sql_queries

__all__ = ["QUERIES", "sql_queries"]
