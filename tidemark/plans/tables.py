"""Reading the given tables, and a registrar for queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registrar():
    """(queries, oracles, decorator): the decorator takes the SQL, or nothing where SQL can't express the query."""
    queries, oracles = {}, {}

    def register(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return put

    return queries, oracles, register
