"""Operators for training data; nothing outside this package imports it."""

from __future__ import annotations

from strandloom.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
