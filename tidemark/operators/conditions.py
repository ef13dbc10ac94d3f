"""Search conditions as column expressions.

A condition may use either vocabulary (attribute, comparator, value, or
search_attribute, search_type, search_value); without a comparator it asks for
equality. A list is a conjunction. Groups `{"operator": "or", "conditions":
[...]}` and the comparators beyond equals, greater_than and
greater_than_equal are extensions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal(condition: dict) -> tuple[str, str, object]:
    attribute = condition.get("attribute", condition.get("search_attribute"))
    comparator = condition.get("comparator", condition.get("search_type")) or "equals"
    value = condition["value"] if "value" in condition else condition.get("search_value")
    if attribute is None:
        raise ValueError(f"a condition needs an attribute: {condition}")
    return attribute, comparator, value


def typed(df: DataFrame, attribute: str, value) -> Column:
    """The value in the attribute's type, null where it can't be."""
    return F.lit(value).try_cast(df.schema[attribute].dataType)


def predicate(df: DataFrame, condition: dict) -> Column:
    if "conditions" in condition:
        parts = [predicate(df, c) for c in condition["conditions"]]
        either = condition.get("operator", "and") == "or"
        return reduce((lambda a, b: a | b) if either else (lambda a, b: a & b), parts, F.lit(not either)) if parts else F.lit(True)
    attribute, comparator, value = normal(condition)
    c = F.col(f"`{attribute}`")
    text = dict(df.dtypes)[attribute] == "string"
    if comparator in ("equals", "equal") and value is None:
        return c.isNull()
    if value == "" and not text and comparator in ("greater_than", "greater_than_equal"):
        return c.isNotNull()  # from the start
    if comparator == "between":
        low, high = (typed(df, attribute, v) for v in value)
        return c.between(low, high)
    if comparator == "in":
        return c.isin([v for v in value])
    v = typed(df, attribute, value)
    tests = {
        "equals": lambda: c == v,
        "equal": lambda: c == v,
        "greater_than": lambda: c > v,
        "greater_than_equal": lambda: c >= v,
        "less_than": lambda: c < v,
        "less_than_equal": lambda: c <= v,
        "not_equal": lambda: c != v,
        "contains": lambda: c.cast("string").contains(str(value)),
        "starts_with": lambda: c.cast("string").startswith(str(value)),
        "ends_with": lambda: c.cast("string").endswith(str(value)),
    }
    if comparator not in tests:
        raise ValueError(f"unknown comparator {comparator!r}")
    return tests[comparator]()


def conjunction(df: DataFrame, conditions: list[dict]) -> Column:
    return reduce(lambda a, b: a & b, [predicate(df, c) for c in conditions], F.lit(True))
