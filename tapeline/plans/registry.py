"""All queries of the core by name."""

from __future__ import annotations

from tapeline.plans import bars, book, flow, panel, problems, records

MODULES = (problems, flow, bars, book, panel, records)
FLAGSHIP = "minute_flow"
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
