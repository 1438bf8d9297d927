"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL oracles.

Every query reads the whole driver tables (through ``Catalog``) and runs the
operator with its default parameters. Oracles are independent DuckDB SQL over
the same raw tables (see ``sqlviews``); a query without an oracle entry is an
iterative / randomised one that is checked by tests against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquee.sources.catalog import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CATALOGS: dict[tuple[int, str], Catalog] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    key = (id(spark), sf_dir)
    if key not in _CATALOGS:
        _CATALOGS[key] = Catalog(spark, sf_dir)
    return _CATALOGS[key]


def register(name: str, oracle: str | None = None):
    def deco(fn: Callable[[Catalog], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(catalog(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries (idempotent)."""
    from marquee.plans import (q_activity, q_browse, q_content, q_graph, q_io, q_persons,  # noqa: F401
                              q_profiles, q_reports)
