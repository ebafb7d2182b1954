"""All registered queries."""

from __future__ import annotations

from usagelens.plans import (  # noqa: F401
    catalog_functions,
    catalog_jobs,
    catalog_reports,
    catalog_sources,
    catalog_streaming,
    catalog_streams,
    catalog_time,
)
from usagelens.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
