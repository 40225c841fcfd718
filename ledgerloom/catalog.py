"""The engine's queries and their SQL."""

from __future__ import annotations

from .plans import capture_queries  # noqa: F401  registers its queries
from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir: str):
    return QUERIES["reconciled"](spark, sf_dir)
