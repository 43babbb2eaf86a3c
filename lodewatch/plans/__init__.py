"""Operators bound to tables: the registered queries and their SQL."""

from __future__ import annotations

from . import builds, code, learning, masks, processes, records, scan, sessions, telemetry

MODULES = [scan, code, masks, sessions, telemetry, builds, learning, records, processes]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}


def flagship(spark, sf_dir):
    """Documents to lines to findings to a score and verdict by source."""
    return scan.agency_score_by_source(spark, sf_dir)
