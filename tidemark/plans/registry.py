"""All queries of the market-analytics engine and their SQL oracles."""

from __future__ import annotations

from . import indicators, learning, risk, similarity  # noqa: F401
from .kit import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

FLAGSHIP = "risk_fusion"
