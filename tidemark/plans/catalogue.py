"""Every query by name, and the SQL that a second engine answers it with."""

from __future__ import annotations

from . import core, documents, ingest, posts, studies, writes

FLAGSHIP = "lead_events"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for part in (core, ingest, posts, documents, writes, studies):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL
