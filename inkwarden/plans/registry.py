"""Names of the engine's queries, and SQL that must give the same rows."""

from inkwarden.plans import source_queries  # noqa: F401  registers its queries
from inkwarden.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
