"""Reading records: by key, by value, by conditions, by REST query, in key order."""

from __future__ import annotations

from urllib.parse import parse_qsl, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .conditions import conjunction, typed


def project(df: DataFrame, attributes: list[str] | None) -> DataFrame:
    """The named attributes; none or `*` is all."""
    return df if not attributes or "*" in attributes else df.select(*[f"`{a}`" for a in attributes])


def search(df: DataFrame, query: dict | list | None = None, key: str | None = None) -> DataFrame:
    """conditions, sort, limit, offset and get_attributes of a query; an empty query is the whole table.

    A sort breaks ties by the key, so pages and limits are the same each time.
    """
    query = {"conditions": query} if isinstance(query, list) else dict(query or {})
    out = df.where(conjunction(df, query.get("conditions") or []))
    if sort := query.get("sort"):
        first = F.col(f"`{sort['attribute']}`")
        out = out.orderBy(first.desc() if sort.get("descending") else first.asc(), *([F.col(f"`{key}`")] if key and key != sort["attribute"] else []))
    if query.get("offset"):
        out = out.offset(query["offset"])
    if query.get("limit") is not None:
        out = out.limit(query["limit"])
    return project(out, query.get("get_attributes"))


def search_by_id(df: DataFrame, key: str, ids: list, attributes: list[str] | None = None) -> DataFrame:
    """Records of the given keys; keys that aren't there are left out. Long lists become a join."""
    if len(ids) <= 1000:
        found = df.where(F.col(key).isin([i for i in ids]))
    else:
        wanted = df.sparkSession.createDataFrame([(i,) for i in ids], "_id string").select(F.col("_id").try_cast(df.schema[key].dataType).alias(key)).distinct()
        found = df.join(wanted, key, "left_semi")
    return project(found, attributes)


def search_by_value(df: DataFrame, attribute: str, value, attributes: list[str] | None = None) -> DataFrame:
    """Records with that value; a lone `*` is every record."""
    return project(df if value == "*" else df.where(F.col(attribute) == typed(df, attribute, value)), attributes)


def search_by_conditions(df: DataFrame, conditions: list[dict], attributes: list[str] | None = None) -> DataFrame:
    return project(df.where(conjunction(df, conditions)), attributes)


def get(df: DataFrame, key: str, value) -> DataFrame:
    """The record of a key, or no row."""
    return df.where(F.col(key) == typed(df, key, value)).limit(1)


def rest(df: DataFrame, key: str, target: str) -> DataFrame:
    """`/`, `/id` or `/?attr=value&...` of a collection."""
    path, _, query = target.partition("?")
    item = unquote(path.strip("/"))
    if item:
        return get(df, key, item)
    return df.where(conjunction(df, [{"attribute": a, "value": v} for a, v in parse_qsl(query, keep_blank_values=True)]))


def key_range(df: DataFrame, key: str, start=None, exclusive: bool = False) -> DataFrame:
    """Records in key order from a key on, so a scan can be resumed behind the last key seen."""
    c = F.col(key)
    return (df if start is None else df.where(c > typed(df, key, start) if exclusive else c >= typed(df, key, start))).orderBy(key)


def index_scan(df: DataFrame, attribute: str, key: str) -> DataFrame:
    """(value, key) of a secondary index in its order, null values first."""
    return df.select(attribute, key).orderBy(F.col(attribute).asc_nulls_first(), key)


def first_passing(df: DataFrame, test, order: list[str]) -> DataFrame:
    """The first row, in an order, that passes a test."""
    return df.where(test).orderBy(*order).limit(1)


def prefix_range(df: DataFrame, keys: list[str], prefix: list) -> DataFrame:
    """Records whose composite key begins with these values, in key order."""
    out = df
    for name, value in zip(keys, prefix, strict=False):
        out = out.where(F.col(name) == typed(df, name, value))
    return out.orderBy(*keys)
