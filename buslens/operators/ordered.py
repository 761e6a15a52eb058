"""Order-dependent operators that never gather one key into one task.

Rows are range-partitioned into balanced sorted slices (``sorted_slices``).
Inside a slice an ordinary window does the work; what must cross a slice border
is carried in a table with one row per (slice, key), at most as many rows as
there are slices plus keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buslens.scale import lookup_join, materialise, sorted_slices


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """1-based row number per key, in the given order, exact for any skew.

    Position inside a slice comes from the sort itself, so the only shuffle is
    the range partitioning.
    """
    slices = sorted_slices(df, keys, order)
    heads = slices.groupBy("_slice", *keys).agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = heads.select(
        "_slice", *keys, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    rows = lookup_join(slices, materialise(offsets, "offsets"), ["_slice", *keys], "inner", null_safe=True)
    number = F.col("_pos") - F.col("_first") + F.col("_before") + 1
    return rows.withColumn(name, number.cast("bigint")).select(*df.columns, name)


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Add values of the previous row of the same key (``{new name: column}``)."""
    slices = sorted_slices(df, keys, order)
    values = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    tails = slices.groupBy("_slice", *keys).agg(F.max_by(values, "_pos").alias("_last"))
    by_key = Window.partitionBy(*keys).orderBy("_slice")
    carried = tails.select("_slice", *keys, F.lag("_last").over(by_key).alias("_carried"))
    inside = Window.partitionBy("_slice", *keys).orderBy("_pos")
    rows = slices.withColumn("_previous", F.lag(values).over(inside))
    rows = lookup_join(rows, materialise(carried, "carried"), ["_slice", *keys], "inner", null_safe=True)
    # A struct is null only when there is no previous row inside the slice.
    previous = F.coalesce("_previous", "_carried")
    return rows.withColumns({n: previous[n] for n in columns}).select(*df.columns, *columns)


def with_last(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Add the last values that are not null up to each row of its key (``{new name: column}``)."""
    slices = sorted_slices(df, keys, order)
    inside = Window.partitionBy("_slice", *keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = slices.groupBy("_slice", *keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(f"_tail_{n}") for n, c in columns.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("_slice", *keys, *[F.last(f"_tail_{n}", True).over(earlier).alias(f"_carried_{n}") for n in columns])
    rows = slices.withColumns({f"_own_{n}": F.last(c, True).over(inside) for n, c in columns.items()})
    rows = lookup_join(rows, materialise(carried, "carried"), ["_slice", *keys], "inner", null_safe=True)
    return rows.withColumns({n: F.coalesce(f"_own_{n}", f"_carried_{n}") for n in columns}).select(*df.columns, *columns)


def with_running_sum(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Add the sums of columns up to each row of its key (``{new name: column}``); null counts as nothing."""
    slices = sorted_slices(df, keys, order)
    inside = Window.partitionBy("_slice", *keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = slices.groupBy("_slice", *keys).agg(*[F.sum(c).alias(f"_total_{n}") for n, c in columns.items()])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_slice", *keys, *[F.sum(f"_total_{n}").over(earlier).alias(f"_carried_{n}") for n in columns])
    rows = slices.withColumns({f"_own_{n}": F.sum(c).over(inside) for n, c in columns.items()})
    rows = lookup_join(rows, materialise(carried, "carried"), ["_slice", *keys], "inner", null_safe=True)
    sums = {n: F.coalesce(f"_own_{n}", F.lit(0)) + F.coalesce(f"_carried_{n}", F.lit(0)) for n in columns}
    return rows.withColumns(sums).select(*df.columns, *columns)
