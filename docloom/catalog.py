"""All queries of the library outside the language-model operators, with their DuckDB twins."""

from __future__ import annotations

from docloom.plans import edits, indexes, lineages, pages, scalars, star, surface, tables, texts, updates, work  # noqa: F401
from docloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
