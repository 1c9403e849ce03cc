"""Registered queries over the driver's tables, one or more an operator, and their SQL for the oracle."""

from __future__ import annotations

from . import aggregation, details, graph, joining, project, scalar, windows, workflows  # noqa: F401  (they register themselves)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
