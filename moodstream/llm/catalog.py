"""Registered queries of the subpackage, each with its SQL where SQL can express it."""

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from moodstream.llm import chat, decontaminate, lines, mixing, perplexity, pii, quality, resample, search, simhash, tokens, toxicity, warc

_SECTIONS = [quality, warc, toxicity, chat, tokens, mixing, simhash, decontaminate, lines, perplexity, search, resample, pii]


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shipped(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """`build`, with Python tasks finding this package wherever the driver was started from."""

    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        environment = spark.sparkContext.environment
        paths = environment.get("PYTHONPATH", "").split(os.pathsep)
        if _ROOT not in paths:
            environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
        return build(spark, sf_dir)

    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: shipped(build) for section in _SECTIONS for key, build in section.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {key: sql for section in _SECTIONS for key, sql in section.SQL.items()}
