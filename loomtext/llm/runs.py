"""All pairs within groups, group by group in sorted partitions, with large groups cut into a grid of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import pinned, small_side

BLOCK = 1024


def gridded(rows: DataFrame, key: list[str], by: str, block: int = BLOCK, *, few: bool = False) -> DataFrame:
    """The narrow `rows` of groups of two or more, each once for each cell (lo, hi) of its group's grid that it is in.

    A group of n rows has ceil(n / block) blocks by a hash of `by`; `own` is a row's block. Cell (i, j) gets blocks
    i and j, so every pair of rows meets in the cell of its blocks, and no task needs more than two blocks at once. Where groups
    are `few`, their sizes are written, and broadcast if they are small, so that wide rows aren't shuffled to meet them.
    """
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = rows.join(small_side(pinned(sizes, "sizes")) if few else sizes, key).withColumn("own", F.pmod(F.xxhash64(by, F.lit(1)), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return other.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other")


def crossing(own_a, own_b, lo, hi):
    """Whether a pair belongs to the cell: one row from block lo, one from hi."""
    return (np.minimum(own_a, own_b) == lo) & (np.maximum(own_a, own_b) == hi)


def dealt(rows: DataFrame, key: list[str], *then: str) -> DataFrame:
    """rows with those of equal key side by side, sorted by `then`."""
    return rows.repartition(*key).sortWithinPartitions(*key, *then)


def framed(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The batches put together to frames of at least `rows` rows, but for the last."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def runs(batches: Iterator[pd.DataFrame], key: list[str], whole: Callable[[pd.DataFrame, np.ndarray], Iterator[pd.DataFrame]]) -> Iterator[pd.DataFrame]:
    """Calls whole(frame, bounds) with frames of complete groups of sorted rows: group g is rows bounds[g]:bounds[g + 1]."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = [batch[c].to_numpy() for c in key]
        change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        if held:
            last = held[-1]
            if any(last[c].iloc[-1] != v[0] for c, v in zip(key, values)):
                yield from _call(held, key, whole)
                held = []
        if len(change):
            yield from _call([*held, batch.iloc[: change[-1]]], key, whole)
            held = [batch.iloc[change[-1] :]]
        else:
            held.append(batch)
    if held:
        yield from _call(held, key, whole)


def _call(parts: list[pd.DataFrame], key: list[str], whole) -> Iterator[pd.DataFrame]:
    frame = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
    differs = np.any([frame[c].to_numpy()[1:] != frame[c].to_numpy()[:-1] for c in key], axis=0)
    yield from whole(frame, np.concatenate([[0], np.flatnonzero(differs) + 1, [len(frame)]]))
