"""Queries of the package's own operators, by name, and their DuckDB counterparts."""

from __future__ import annotations

from . import q_corpus, q_speech, q_structure, q_text, q_workloads  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
