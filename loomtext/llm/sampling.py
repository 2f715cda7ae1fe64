"""Bounded samples by least hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 64


def least_hashed(rows: DataFrame, h: Column, n: int) -> DataFrame:
    """The n rows with the least 64-bit hash; all if there are no more.

    Of many rows only those in the share of the hash's range that holds about 4 n are ordered, so that what tasks
    send to the one that orders them doesn't grow with their number. Ties are cut at n. If repeated hashes leave
    fewer than n in that share, all rows are ordered.
    """
    total = rows.count()
    if total > 8 * n:
        few = rows.where(h < F.lit(int(4 * n / total * _SPAN) - (1 << 63)))
        if few.limit(n).count() == n:
            rows = few
    return rows.orderBy(h).limit(n)
