"""Literal tables for what the generated tables do not hold: the same rows for Spark and for oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def rows(spark: SparkSession, table: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(table, schema)


def values(table: list[tuple], columns: str) -> str:
    """The rows as an SQL table expression with the given columns."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]"
        return str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in table) + f") t({columns})"
