"""The functions of the library under names for SQL, and the place where detectors are registered."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators import alerts
from ..sources.pages import turbo_stream
from .text import common_length


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: twice the longest common subsequence over both lengths."""
    return pd.Series([None if x is None or y is None else 100.0 if not x and not y else 200.0 * common_length(x, y) / (len(x) + len(y)) for x, y in zip(a, b)], dtype="Float64")


def register(spark: SparkSession) -> list[str]:
    """Registers likeness and turbo_stream for SQL; what is built in needs no registration."""
    spark.udf.register("likeness", likeness)
    spark.udf.register("turbo_stream", turbo_stream)
    return ["likeness", "turbo_stream"]


def detector(name: str) -> Callable:
    """Adds a detector (observations, run id -> events) to those that the alert engine runs. Its columns are checked when it is used."""

    def add(f: Callable[[DataFrame, int], DataFrame]) -> Callable[[DataFrame, int], DataFrame]:
        if name in alerts.DETECTORS:
            raise ValueError(f"{name} is registered")
        alerts.DETECTORS[name] = f
        return f

    return add
