"""All queries of the engine."""

from glyphsphere.plans import codepoint_queries, composition_queries, relation_queries, source_queries, text_queries, vector_queries  # noqa: F401
from glyphsphere.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
