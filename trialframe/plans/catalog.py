"""All registered queries."""

from . import (  # noqa: F401
    queries_analyses,
    queries_catalog,
    queries_eval,
    queries_raster,
    queries_selection,
    queries_signal,
    queries_stats,
)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
