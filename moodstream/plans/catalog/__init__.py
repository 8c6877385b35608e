"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from moodstream.plans.catalog import (
    aggregates,
    evaluation,
    jobs,
    joins,
    learning,
    projections,
    ranks,
    scalars,
    storage,
    streams,
    windows,
)
from moodstream.plans.catalog.common import BASE, comparable

_SECTIONS = [
    storage,
    projections,
    joins,
    aggregates,
    evaluation,
    windows,
    ranks,
    scalars,
    learning,
    streams,
    jobs,
]


def _runner(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(build(spark, sf_dir))

    run.__name__ = build.__name__
    run.__doc__ = build.__doc__
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: _runner(build) for section in _SECTIONS for key, build in section.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {key: BASE + sql for section in _SECTIONS for key, sql in section.SQL.items()}
