"""All queries outside the optional corpus operators, with their SQL."""

from __future__ import annotations

from siltstone.plans import link_queries, question_queries, report_queries, search_queries, text_queries

_MODULES = (search_queries, report_queries, question_queries, text_queries, link_queries)


def queries() -> dict:
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
