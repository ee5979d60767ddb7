"""All registered queries of the library."""

from __future__ import annotations

from gleanery.plans import archives, dashboards, notices, places, records, registry, sources

QUERIES, ORACLE_SQL = registry.QUERIES, registry.ORACLE_SQL
__all__ = ["QUERIES", "ORACLE_SQL", "archives", "dashboards", "notices", "places", "records", "sources"]
