"""All registered queries of the library and their SQL."""

from __future__ import annotations

from .plans import queries_fields, queries_io, queries_joins, queries_measures, queries_models, queries_more, queries_plans, queries_records, queries_windows

MODULES = (queries_windows, queries_joins, queries_measures, queries_plans, queries_more, queries_io, queries_fields, queries_models, queries_records)
FLAGSHIP = "event_detection"


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
