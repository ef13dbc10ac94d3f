"""Running aggregates along an order, of which no key's rows have to be in one task.

Rows are cut into stretches of the first column of the order, of about equal
numbers of rows; each stretch of a key is run through on its own, the results
of stretches (one row each) are carried over, and both are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A stretch has about this many rows, and there are this many stretches at most.
STRETCH_ROWS, MOST = 1 << 20, 64


def stretch(df: DataFrame, order: str, stretches: int | None = None) -> Column:
    """Which stretch a row is in: how many of the table's approximate quantiles lie at or below it (null: none)."""
    stretches = stretches or min(MOST, -(-df.count() // STRETCH_ROWS))
    if stretches <= 1:
        return F.lit(0)
    kind = df.schema[order].dataType
    number = F.unix_micros(F.col(order).cast("timestamp")).cast("double") if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(order).cast("double")
    bounds = sorted(set(df.select(number.alias("n")).approxQuantile("n", [k / stretches for k in range(1, stretches)], 1 / (2 * stretches))))

    def place(low: int, high: int):
        """A search by halves."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(number >= bounds[middle], place(middle + 1, high)).otherwise(place(low, middle))

    return place(0, len(bounds))


def running(df: DataFrame, by: list[str], order: list[str], what: dict[str, tuple[str, str]], stretches: int | None = None) -> DataFrame:
    """Adds, for each name in `what`, the running `sum` or `max` of a column over the rows of a key up to this one.

    Rows that are equal in order are one another's peers and see each other,
    as with SQL's default window frame.
    """
    fold = {"sum": F.sum, "max": F.max}
    cut = df.withColumn("_stretch", stretch(df, order[0], stretches))
    own = Window.partitionBy(*by, "_stretch").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumns({name: fold[f](c).over(own) for name, (f, c) in what.items()})
    ends = cut.groupBy(*by, "_stretch").agg(*[fold[f](c).alias(f"_end_{name}") for name, (f, c) in what.items()])
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    # At most `stretches` rows a key.
    carried = ends.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_stretch").alias("_s"), *[fold[f](f"_end_{name}").over(earlier).alias(f"_carry_{name}") for name, (f, _) in what.items()])
    on = F.col("_stretch") == F.col("_s")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = local.join(carried, on)
    both = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": F.greatest}
    return joined.select(*df.columns, *[F.coalesce(both[f](F.col(name), F.col(f"_carry_{name}")), F.col(f"_carry_{name}")).alias(name) for name, (f, _) in what.items()])


def before(df: DataFrame, by: list[str], order: str, columns: list[str], stretches: int | None = None) -> DataFrame:
    """Adds `_prev_<column>` of the row before in a key; the order is the row's own. Null for a key's first row."""
    cut = df.withColumn("_stretch", stretch(df, order, stretches))
    own = Window.partitionBy(*by, "_stretch").orderBy(order)
    local = cut.withColumns({f"_prev_{c}": F.lag(c).over(own) for c in columns} | {"_nth": F.row_number().over(own)})
    last = cut.groupBy(*by, "_stretch").agg(F.max_by(F.struct(*columns), order).alias("_last"))
    carried = last.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_stretch").alias("_s"), F.lag("_last").over((Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("_stretch")).alias("_before"))
    on = F.col("_stretch") == F.col("_s")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = local.join(carried, on)
    return joined.select(*df.columns, *[F.when(F.col("_nth") == 1, F.col(f"_before.{c}")).otherwise(F.col(f"_prev_{c}")).alias(f"_prev_{c}") for c in columns])
