"""Registry of queries and the SQL each one is compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}

PLACES = 6


def query(key: str, sql: str | None = None):
    """Register a query under its key, with the DuckDB statement giving the same rows."""

    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return register


def with_ctes(sql: str) -> str:
    """Prefix a statement with the named sub-queries it uses, directly or not."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in CTES and name not in seen:
                seen.add(name)
                visit(CTES[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{name} AS ({CTES[name]})" for name in needed)
    recursive = "RECURSIVE " if "/*recursive*/" in head + sql else ""
    return f"WITH {recursive}{head}\n{sql}"


def r6(column: Column | str) -> Column:
    return F.round(column, PLACES)


# SQL snippets -----------------------------------------------------------------


def words(items: tuple[str, ...]) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


def tok(expr: str) -> str:
    return rf"regexp_extract_all(replace(lower({expr}), 'ß', 'ss'), '[\p{{L}}\p{{M}}\p{{N}}]+')"


def content(tokens: str, items: tuple[str, ...]) -> str:
    kept = f"list_filter({tokens}, lambda t: NOT list_contains({words(items)}, t))"
    return f"(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {tokens} END)"


def sents(expr: str) -> str:
    marked = rf"regexp_replace({expr}, '([.!?。！？।॥])\s+|\n+', '\1' || chr(1), 'g')"
    return (
        f"list_filter(list_transform(string_split({marked}, chr(1)), "
        f"lambda s: {strip(chr(115))}), lambda s: s <> '')"
    )


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def unit(expr: str) -> str:
    norm = f"sqrt(list_sum(list_transform({expr}, lambda y: y::DOUBLE * y::DOUBLE)))"
    return f"list_transform({expr}, lambda x: (x::DOUBLE / {norm})::FLOAT)"
