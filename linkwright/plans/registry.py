"""Queries by name, with SQL that gives the same rows."""

from __future__ import annotations

from linkwright.plans import network, quality, resolution

MODULES = (quality, resolution, network)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
