"""Registered queries of the library and the SQL that must give the same rows."""

from __future__ import annotations

from formweave.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
