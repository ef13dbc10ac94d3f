"""Rows as the text of a response, by content type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"application/json": F.to_json, "text/csv": F.to_csv}


def body(rows: DataFrame, content_type: str) -> Column:
    """Each row as one line of that type; an unknown type is an error."""
    if content_type not in KINDS:
        raise ValueError(f"no serialiser for {content_type}")
    return KINDS[content_type](F.struct(*[F.col(f"`{c}`") for c in rows.columns]))


def write(rows: DataFrame, path: str, content_type: str) -> None:
    """Writes all rows below a path, a file a partition."""
    rows.select(body(rows, content_type).alias("value")).write.mode("overwrite").text(path)
