"""Queries by name, with the SQL an independent engine answers them by."""

from . import chunks, evaluation, filings, operations, reports, retrieval, tables

_MODULES = (retrieval, evaluation, chunks, tables, filings, operations, reports)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
