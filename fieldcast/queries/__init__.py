"""Registered queries: each operator over the given tables, with the SQL that must agree."""

from . import compaction, feeds, model, places, scalars, snapshots, voting, works  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
