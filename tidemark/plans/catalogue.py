"""The registered queries over the library's operators, with SQL for the same rows."""

from __future__ import annotations

from tidemark.plans import audits, evidence, media, planning, relations, scoring, views

_MODULES = (scoring, relations, audits, evidence, views, media, planning)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
