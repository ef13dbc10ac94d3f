"""Relationships between tables, index joins and key-set checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def many_to_one(df: DataFrame, foreign: str, other: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the related record as a struct, null where there is none."""
    nested = other.select(F.col(key).alias("_k"), F.struct(*other.columns).alias(name))
    return df.join(nested, F.col(foreign) == F.col("_k"), "left").drop("_k")


def one_to_many(df: DataFrame, key: str, other: DataFrame, foreign: str, name: str, order: str) -> DataFrame:
    """Adds the records that point here as an array in `order`, empty where there are none."""
    nested = other.groupBy(F.col(foreign).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in other.columns if c != order]))).alias(name))
    kind = nested.schema[name].dataType
    return df.join(nested, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def many_to_many(df: DataFrame, key: str, ids: str, other: DataFrame, other_key: str, name: str) -> DataFrame:
    """Adds the records named by an array of ids, in its order and with its repeats; missing ones are left out."""
    spread = df.select(F.col(key).alias("_k"), F.posexplode(ids).alias("_pos", "_id"))
    found = spread.join(other.select(F.col(other_key).alias("_id"), F.struct(*other.columns).alias("_r")), "_id")
    nested = found.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_pos", "_r"))).alias("_l")).select("_k", F.transform("_l", lambda x: x["_r"]).alias(name))
    kind = nested.schema[name].dataType
    return df.join(nested, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def many_to_many_reverse(df: DataFrame, key: str, other: DataFrame, other_key: str, ids: str, name: str) -> DataFrame:
    """Adds the sorted keys of records whose id arrays hold this key."""
    held = other.select(F.col(other_key).alias("_o"), F.explode(ids).alias("_k")).groupBy("_k").agg(F.array_sort(F.collect_set("_o")).alias(name))
    return df.join(held, F.col(key) == F.col("_k"), "left").drop("_k")


def index_lookup(index: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Base records of index entries; an entry without a record is skipped."""
    return base.join(index.select(key), key)


def dangling(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key): keys that one side has and the other doesn't."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("left").alias("side"), key).union(b.join(a, key, "left_anti").select(F.lit("right").alias("side"), key))


def keyset_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """One row: keys on both sides, missing and extra."""
    a, b = expected.select(key).distinct().withColumn("_a", F.lit(1)), actual.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"), F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("extra"))
