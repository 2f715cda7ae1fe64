"""Mixing sources to target weights by Poisson replication.

Each source has a rate: how often its documents repeat on average in the mixture. A document's count is
the inverse of the Poisson distribution of that mean at a uniform number hashed from (seed, doc_id); the
document is exploded by its count, and all copies are dealt out anew by a hash of (seed, doc_id, copy).

Defined cases: a null source is a source of its own, named ''. Sources without a target weight have rate 0
when weights are given. Rows with equal doc_id get equal counts; a null doc_id hashes as 'null'. An empty
table gives an empty mixture. Other columns pass through, whatever their names: only an input column with the name of
one of the four that are added (mix_rate, mix_copies, mix_copy, mix_key) is replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.session import small_side

SEED = 17
EXPONENT = 0.5
_DIGITS = 13


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by colons."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long") / float(16**_DIGITS)


def poisson_steps(rate: float, least: float = 1e-12) -> tuple[int, np.ndarray]:
    """(first, P(X <= first), P(X <= first + 1), ...) up to the last that is below 1 - least. The count at u is `first`
    and how many of them u reaches.

    Probabilities more than 40 deviations off the rate are 0 in doubles, so there are about 80 sqrt(rate) of them.
    """
    if not rate > 0:
        return 0, np.zeros(0)
    reach = 40 * math.sqrt(rate) + 40
    first, last = max(0, math.floor(rate - reach)), math.ceil(rate + reach)
    logs = np.concatenate([[first * math.log(rate) - rate - math.lgamma(first + 1)], math.log(rate) - np.log(np.arange(first + 1, last + 1))])
    steps = np.cumsum(np.exp(np.cumsum(logs)))
    return first, steps[: int(np.searchsorted(steps, 1 - least)) + 1]


def poisson_counts(rates: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The inverse of each rate's Poisson distribution at u, a rate's rows at once."""
    out = np.zeros(len(u), np.int64)
    for rate in np.unique(rates[~np.isnan(rates)]):
        mine = np.flatnonzero(rates == rate)
        first, steps = poisson_steps(float(rate))
        out[mine] = first + np.searchsorted(steps, u[mine], side="right")
    return out


def rates(docs: DataFrame, *, weights: dict[str, float] | None = None, exponent: float = EXPONENT, total: float = 1.0) -> DataFrame:
    """(source_key, rate): by given weights, else by each source's share of characters to the power `exponent`.

    `total` is the mixture's expected size as a multiple of the input's, in characters.
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source_key")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1).alias("size"))
    if weights is not None:
        wanted = docs.sparkSession.createDataFrame(sorted(weights.items()), "source_key string, weight double")
        sizes = sizes.join(small_side(wanted), "source_key", "left").na.fill({"weight": 0.0})
    else:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(exponent)))
    sums = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    return sizes.crossJoin(F.broadcast(sums)).select("source_key", F.coalesce(F.round(F.lit(total) * F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size"), 9), F.lit(0.0)).alias("rate"))


ADDED = ("mix_rate", "mix_copies", "mix_copy", "mix_key")


def replicate(docs: DataFrame, source_rates: DataFrame, *, seed: int = SEED, added: bool = True) -> DataFrame:
    """docs once for each copy, with mix_rate, mix_copies, mix_copy (from 1) and mix_key, dealt out and ordered by
    mix_key; with docs' own columns alone, and all of them, unless `added`."""

    @F.pandas_udf("long")
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rate, u in batches:
            yield pd.Series(poisson_counts(rate.to_numpy(float), u.to_numpy(float)))

    # The row travels as one struct: no name of its columns can meet one of ours.
    kept = [c for c in docs.columns if not added or c not in ADDED]
    known = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*(docs[c] for c in kept)).alias("row"), F.coalesce("source", F.lit("")).alias("source_key"), known.alias("known"))
    counted = rows.join(small_side(source_rates.select("source_key", "rate")), "source_key").withColumn("copies", count("rate", uniform(F.lit(str(seed)), F.col("known"))))
    copies = counted.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    keyed = copies.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), "known", "copy"))).repartition(F.col("key")).sortWithinPartitions("key")
    about = [F.col("rate").alias("mix_rate"), F.col("copies").cast("int").alias("mix_copies"), F.col("copy").cast("int").alias("mix_copy"), F.col("key").alias("mix_key")]
    return keyed.select("row.*", *(about if added else []))
