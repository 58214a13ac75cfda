"""Plans: the engine's queries, each over whole tables, with their SQL equivalents."""

from tessera.plans import field_queries, fold_queries, log_queries, score_queries, source_queries, story_queries, text_queries, view_queries  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
