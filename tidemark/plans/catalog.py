"""All registered queries of the reference's operators, with the SQL that must give the same rows."""

from __future__ import annotations

from tidemark.plans import audits, features, monitoring
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audits", "features", "monitoring"]
