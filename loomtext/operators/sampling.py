"""Seeded sampling that depends on row values alone, not on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import pinned, small_side


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from a hash of the seed and the parts."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(16**13)


def sample_per_group(docs: DataFrame, n: int, *, seed: int, group: str = "lang") -> DataFrame:
    """Exactly n rows of each group, or all of a smaller one, without replacement; `sample_rank` is their order.

    Rows are in the order of MD5(seed:doc_id), so its leading digits are uniform. Groups are counted, and only rows
    below the cut that a sample of n lies under with near certainty are ordered: about n and a few roots of n
    of each group in all, however many tasks read it, and they are written once. A group of which the cut left too
    few is ordered whole.
    """
    named = F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))
    sizes = pinned(docs.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__size")), "sizes")
    share = (n + 8 * math.sqrt(n) + 32) / F.col("__size")
    placed = docs.withColumn("__at", F.md5(named)).join(small_side(sizes), F.col(group).eqNullSafe(F.col("__group")))
    near = pinned(placed.where(uniform(seed, F.col("doc_id").cast("string")) < share), "near")
    left = near.groupBy("__group").agg(F.count("*").alias("__left")).withColumnRenamed("__group", "__found")
    short = pinned(sizes.join(left, F.col("__group").eqNullSafe(F.col("__found")), "left").where(F.coalesce("__left", F.lit(0)) < F.least(F.lit(n), F.col("__size"))).select(F.col("__group").alias("__short")), "short")
    if not short.isEmpty():
        same = F.col("__group").eqNullSafe(F.col("__short"))
        near = near.join(small_side(short), same, "left_anti").unionByName(placed.join(small_side(short), same, "left_semi"))
    order = Window.partitionBy(group).orderBy("__at", "doc_id")
    return near.withColumn("sample_rank", F.row_number().over(order)).where(F.col("sample_rank") <= n).drop("__at", "__group", "__size")


def repeat(prompts: DataFrame, n: int) -> DataFrame:
    """Each row n times, with seq from 1."""
    return prompts.withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(n))))


def normal_weights(rows: DataFrame, name: str, columns: int, *, std: float = 0.02, layers: int | None = None, seed: int = 42) -> DataFrame:
    """(name, row, values) of normal draws, a row of the matrix for each row of `rows` (row); residual projections are
    scaled by (2 layers) ** -0.5.

    A draw depends on (seed, name, row, column) alone: two uniform hashes become a normal number (Box-Muller).
    """
    scale = std * ((2 * layers) ** -0.5 if layers else 1.0)
    u = lambda k, i: uniform(seed, F.lit(f"{name}:{k}"), F.col("row").cast("string"), i.cast("string"))
    normal = lambda i: F.sqrt(-2 * F.log(1 - u(0, i))) * F.cos(2 * math.pi * u(1, i)) * scale
    return rows.select(F.lit(name).alias("name"), "row", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), normal).alias("values"))
