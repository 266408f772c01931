"""Registry of the recognition queries: name -> Spark callable and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decoding, files, rasters, recognition, shapes, streams, tokens

_PLANS = (decoding, shapes, rasters, tokens, recognition, streams, files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for plan in _PLANS for f in plan.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for plan in _PLANS for k, v in plan.SQL.items()}
