"""All queries of the engine by key, and the SQL that each must equal."""

from __future__ import annotations

from . import annotation_queries, archive_queries, detection_queries, tensor_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
