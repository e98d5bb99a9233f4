"""All queries by name, and the SQL that checks them."""

from __future__ import annotations

from textloom.plans import arrays, compression, history, outputs, parsers, records, scalars, sessions, shell, source_code, tagging, texts, tooling, xml_reports, zoning

PARTS = (history, texts, scalars, sessions, records, tooling, outputs, compression, arrays, parsers, xml_reports, zoning, tagging, shell, source_code)
QUERIES = {k: f for part in PARTS for k, f in part.QUERIES.items()}
ORACLES = {k: q for part in PARTS for k, q in part.ORACLES.items()}
