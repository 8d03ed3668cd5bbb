"""Named queries over the driver's tables, with SQL that states the same rows."""

from lectern.plans import book_queries, collection_queries, parser_queries, relation_queries, text_queries
from lectern.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "book_queries", "collection_queries", "parser_queries", "relation_queries", "text_queries"]
