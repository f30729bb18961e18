"""Registered queries (one per operator) and their DuckDB oracle SQL.

Every query reads the fixture views built from the driver's whole tables
(see ``sources.fixtures``) and returns a DataFrame whose computed columns are
aliased exactly as in the oracle.  Doubles are rounded to 6 places on both
sides because summation order differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attemptlab.sources.fixtures import Fixtures, get_fixtures, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle, *views)
        return fn
    return deco


def r6(c):
    """Round a double column to 6 places (same rule as the oracle's ``round(x, 6)``)."""
    return F.round(c, 6)


def fixtures(spark: SparkSession, sf_dir: str) -> Fixtures:
    return get_fixtures(spark, sf_dir)


_FLOWS: dict = {}


def cached_flow(cls, spark: SparkSession, sf_dir: str):
    """One lazily built flow object (DataFrame plans only, no data) per class, session and folder."""
    key = (cls.__name__, id(spark._jsparkSession), sf_dir)
    if key not in _FLOWS:
        _FLOWS[key] = cls(spark, sf_dir)
    return _FLOWS[key]


def _load() -> None:
    """Import the query modules; each registers its queries on import."""
    from attemptlab.plans import (queries_attempts, queries_grading, queries_io, queries_prompts,  # noqa: F401
                                  queries_ratings, queries_similarity, queries_testlet)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
