"""Where queries and their SQL counterparts are collected."""

from __future__ import annotations

import re

QUERIES, VIEWS, _SQL = {}, {}, {}


def query(name: str, sql: str | None = None, big: str = ""):
    """Register a query; ``sql`` may name views of ``VIEWS``, which are put in front as needed.

    ``big`` lists columns that the SQL states as small literals and Spark as bigint.
    """

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in big.split())
            _SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if big else sql
        return fn

    return keep


def oracles() -> dict[str, str]:
    """SQL of every query, with the views it names; called once all modules have registered theirs."""
    return {name: with_views(sql) for name, sql in _SQL.items()}


def with_views(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str):
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    heads = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def source(spark, sf_dir: str, view: str):
    """A view of the test tables, defined once in SQL that both engines read."""
    text = with_views(f"SELECT * FROM {view}")
    for name in TABLES:
        text = re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 parquet.`{sf_dir}/{name}.parquet`", text)
    return spark.sql(text)
