"""Registration of queries with their SQL oracles.

``spec`` names the output columns once for both engines: ``name`` is kept as it is,
``name:r`` is a double rounded to six places (taken 1e-9 above the value, so that exact
ties fall the same way in both engines), ``name:i`` a 64-bit integer.
SQL texts may name any shared table of ``TABLES``; the needed ones are put in front
as common table expressions.
"""
from __future__ import annotations

import re
from functools import cached_property  # noqa: F401  (re-exported for views)

from pyspark.sql import DataFrame, functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SPECS: dict[str, str] = {}
TABLES: dict[str, str] = {}


def fields(spec: str):
    for item in spec.split():
        name, _, kind = item.partition(":")
        yield name, kind


def shape(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in fields(spec):
        c = F.col(name)
        if kind == "r":
            c = F.round(c.cast("double") + F.lit(1e-9), 6) + F.lit(0.0)
        elif kind == "i":
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def sql_shape(body: str, spec: str) -> str:
    out = []
    for name, kind in fields(spec):
        if kind == "r":
            out.append(f"round(CAST({name} AS DOUBLE) + 1e-9, 6) + 0.0 AS {name}")
        elif kind == "i":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        else:
            out.append(name)
    return f"SELECT {', '.join(out)} FROM ({body}) AS q"


def table(name: str, sql: str) -> None:
    TABLES[name] = sql.strip()


def with_tables(body: str) -> str:
    """Prefix the shared tables a text needs, dependencies first."""
    done: list[str] = []
    seen: set[str] = set()

    def need(text: str):
        for word in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text)):
            if word in TABLES and word not in seen:
                seen.add(word)
                need(TABLES[word])
                done.append(word)

    need(body)
    if not done:
        return body
    parts = ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in done)
    return f"WITH {parts}\n{body}"


def query(name: str, spec: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``."""
    def deco(fn):
        assert name not in QUERIES, name

        def run(spark, sf_dir, fn=fn, spec=spec):
            from ..sources.stand_in import views
            return shape(fn(views(spark, sf_dir)), spec)

        QUERIES[name], SPECS[name] = run, spec
        if sql is not None:
            ORACLES[name] = sql_shape(sql.strip(), spec)
        return fn
    return deco


def Q(name, fn, spec, sql=None):
    query(name, spec, sql)(fn)
