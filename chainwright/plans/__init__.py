"""Registered queries on the driver tables."""

from chainwright.plans import audits, chains, inference, io, overlap, retrieval, scalars, structures, summaries  # noqa: F401
from chainwright.plans.registry import QUERIES, SQL, Tables

__all__ = ["QUERIES", "SQL", "Tables"]
