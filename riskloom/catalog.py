"""The catalogue of queries: a name, a function (tables) -> DataFrame, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from riskloom.sources.views import VIEWS, Tables


@dataclass
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name."""

    def add(build: Callable[[Tables], DataFrame]):
        CATALOG[build.__name__] = Query(build, sql)
        return build

    return add


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return CATALOG[name].build(Tables(spark, sf_dir))

    run.__name__ = name
    return run


def full_sql(sql: str) -> str:
    """The SQL with the adapter views that it names as common table expressions in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, view in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(view)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    front = ",\n".join(f"{name} AS (\n{VIEWS[name]}\n)" for name in needed)
    body = sql.strip()
    if re.match(r"with\s+recursive\b", body, re.I):
        return f"WITH RECURSIVE {front},\n{re.sub(r'^with\s+recursive', '', body, flags=re.I)}"
    if re.match(r"with\b", body, re.I):
        return f"WITH {front},\n{body[4:]}"
    return f"WITH {front}\n{body}"
