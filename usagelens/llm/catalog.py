"""All queries of this subpackage."""

from __future__ import annotations

from usagelens.llm import query_models, query_native, query_search, query_vectors  # noqa: F401
from usagelens.llm.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
