"""Global positions and running sums without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import pinned


def with_offset(df: DataFrame, key: str | list[str], amount: Column, name: str = "offset", rows_per_part: int = 200_000) -> DataFrame:
    """df with `name`: the sum of `amount` over the rows before it in the order of `key`, nulls first.

    Rows of equal key are ordered by a hash of all columns; equal rows are interchangeable. df is shuffled twice, so
    pass narrow columns and join wide ones on afterwards. Rows are dealt to as many stretches of that order as
    their number asks for, and those are written once; the stretches' sums, one row each, give their starts.
    """
    tie, keys = F.xxhash64(*df.columns), [key] if isinstance(key, str) else key
    parts = max(1, -(-df.count() // rows_per_part))
    staged = df.withColumn("__amount", amount).withColumn("__tie", tie).repartitionByRange(parts, *keys, "__tie")
    staged = pinned(staged.withColumn("__part", F.spark_partition_id()), "stretches")
    sums = staged.groupBy("__part").agg(F.sum("__amount").alias("__sum"))
    starts = sums.select("__part", (F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")).alias("__start"))
    before = Window.partitionBy("__part").orderBy(*keys, "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = staged.withColumn("__within", F.sum("__amount").over(before) - F.col("__amount")).join(starts, "__part")
    return placed.withColumn(name, (F.col("__start") + F.col("__within")).cast("long")).drop("__part", "__amount", "__within", "__start", "__tie")


def with_position(df: DataFrame, key: str | list[str], name: str = "position") -> DataFrame:
    """df with its rows numbered from 0 in the order of `key`."""
    return with_offset(df, key, F.lit(1), name)
