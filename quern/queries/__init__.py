"""Registered queries: for each family a module with Spark callables and SQL side by side."""

from __future__ import annotations

from quern.queries import analytics, beyond_sql, calendar, dates, fields, imports, joins, links, notices, pages, planning, policies, questions, ranking, records, retrieval, rules, schedules, text

FAMILIES = (analytics, calendar, joins, ranking, retrieval, rules, text, records, fields, schedules, questions, planning, policies, notices, beyond_sql, pages, links, dates, imports)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLES = {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
