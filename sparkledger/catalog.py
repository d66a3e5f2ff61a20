"""All registered queries of the log engine and their DuckDB counterparts."""

from __future__ import annotations

from .plans import q_cluster, q_control, q_misc, q_offsets, q_state  # noqa: F401
from .plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
