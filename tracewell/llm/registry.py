"""The queries of this package by name, with the checking SQL where there is one."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    from tracewell.llm import (  # noqa: F401
        hpylm,
        jaccard,
        lines,
        mixing,
        negatives,
        orderhash,
        packing,
        pii,
        quality,
        rules,
        search,
        simhash,
        toxicity,
    )
