"""Imports every query module, which fills the registry."""

from __future__ import annotations

from sievewatch.plans import company, files, governance, listing, officers, reuse, scoring, screening, streams  # noqa: F401
from sievewatch.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
