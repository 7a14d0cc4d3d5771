"""Registry of named queries and their SQL twins.

``@query(name, sql=...)`` registers a ``(spark, sf_dir) -> DataFrame``
callable; ``sql`` is the DuckDB body that must return the same rows with
the same column names (see :mod:`.oracle_views`).  Queries whose result
depends on a learner or a seeded draw register no SQL and are checked by
row count and by unit tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Tables
from .oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn
    return deco


def round_doubles(df: DataFrame, places: int = 4) -> DataFrame:
    """Round every double column (HALF_UP), so that sums taken in another
    order compare equal."""
    return df.withColumns({c: F.round(F.col(c), places) for c, t in df.dtypes if t == "double"})


def load_all() -> None:
    """Import the modules that register queries."""
    from . import (queries_audit, queries_basket, queries_core, queries_io,  # noqa: F401
                   queries_models, queries_profile, queries_whatif)
