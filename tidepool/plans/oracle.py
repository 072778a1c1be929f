"""DuckDB oracle SQL: an independent statement of each query over the same stand-in views."""

from __future__ import annotations

import re

from ..sources.views import VIEWS, view_sql

ORACLE: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix the views a statement mentions as CTEs (the driver registers only base tables)."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    ctes = ",\n".join(f"{v} AS (\n{view_sql(v)}\n)" for v in used)
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def oracle(name: str):
    def deco(sql: str) -> str:
        ORACLE[name] = with_views(sql)
        return sql

    return deco


def register(name: str, sql: str) -> None:
    ORACLE[name] = with_views(sql)
