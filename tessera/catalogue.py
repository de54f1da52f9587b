"""All registered queries with the SQL that checks them."""

from __future__ import annotations

from tessera.plans import frames, library, sql


def queries() -> dict:
    return {name: sql.query(name) for name in sql.SQL} | frames.QUERIES | library.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: sql.oracle_text(name) for name in sql.SQL} | frames.ORACLE | library.ORACLE
