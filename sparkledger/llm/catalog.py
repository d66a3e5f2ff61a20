"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import bpe, decontaminate, html, licenses, line_dedup, near_dup, pii, quality, secrets, substring_dedup

MODULES = (bpe, decontaminate, html, licenses, line_dedup, near_dup, pii, quality, secrets, substring_dedup)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
