"""Registry of named queries: the Spark plan and, where one exists, the
equivalent DuckDB statement used as the correctness oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tollgate.functions.columns import to_ntz
from tollgate.plans.oracle_fixtures import with_fixtures
from tollgate.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DOCS: dict[str, str] = {}


def register(name: str, sql: str | None = None, fixtures: tuple[str, ...] = (),
             extra: dict[str, str] | None = None, recursive: bool = False):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.  Outputs are
    cast to TIMESTAMP_NTZ so that both engines show zone-less times."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return to_ntz(fn(prepare(spark), sf_dir))
        run.__doc__ = fn.__doc__
        run.__name__ = name
        QUERIES[name] = run
        DOCS[name] = (fn.__doc__ or "").strip()
        if sql is not None:
            ORACLES[name] = with_fixtures(sql, *fixtures, extra=extra, recursive=recursive)
        return fn
    return deco
