"""Registered queries over the reference tables, and their SQL."""

from __future__ import annotations

from .plans import contracts, edges, edits, injected, more, registry, replies, writers  # noqa: F401  (add their queries to the catalogue)
from .plans.catalogue import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
