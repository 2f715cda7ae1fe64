"""Quality by importance resampling: two hashed n-gram models and Gumbel top-k.

The target model counts the unigrams and bigrams of a bounded sample of the documents marked good, the raw
model those of all documents; both count whole texts. A document's log weight is the mean of
log p_target - log p_raw over its n-grams, shrunk towards 0 for very short texts. A text counts as one of SCALE
n-grams, however long it is, so that length neither wins nor loses: SCALE times the log weight plus standard Gumbel
noise, seeded by the row's values, is its key, and the k largest keys are kept. Of these, the SHARE with the largest keys
are also `sampled`: a draw without replacement whose chances follow the weights, and which noise does decide.

Unless k is given, it is the number of documents whose log weight is at least a floor that all labels set: the cut
that best parts the documents marked good from those marked bad, in the middle of the gap around it. On texts that
differ as clearly as junk and prose do, the noise decides little: it reorders texts whose weights are within a few
hundredths of each other.

Defined cases: a null or empty text has log weight 0. Ties at the k-th key are all kept. Without documents marked
good every weight is 0; without any marked bad nothing says where to stop; then all are kept. Repeated rows get equal
keys. An empty table gives an empty result. Input columns are kept in a struct, so none can clash with the results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.sampling import least_hashed
from loomtext.llm.tokens import mix, slices, token_hashes
from loomtext.session import pinned

BUCKETS = 1 << 14
TARGET_DOCS = 20_000
SCALE = 100.0
BIN = 1e-3
SHRINK = 30
SHARE = 0.5
_TWICE = np.uint64(0x5851F42D4C957F2D)


def ngrams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every unigram and bigram; all bigrams of a token with itself share a bucket."""
    h, bounds = token_hashes(texts, lower=False, punctuation=True)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    inside = owner[:-1] == owner[1:]
    first, second = h[:-1][inside], h[1:][inside]
    pairs = np.where(first == second, _TWICE, mix(first * np.uint64(3) + second))
    return (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[:-1][inside]])


def fit_ratio(docs: DataFrame, labels: DataFrame, *, target_docs: int = TARGET_DOCS, seed: int = 5) -> np.ndarray | None:
    """log p_target - log p_raw by bucket: the raw counts are over all documents, the target's over a bounded sample.

    The sample is the `target_docs` documents marked good with the least seeded hash of doc_id; only their ids
    are broadcast. Each task returns at most BUCKETS sums, so what is shuffled follows tasks, not words.
    """
    good = labels.where((F.col("quality") > 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    sample = docs.select("doc_id").join(good, "doc_id", "left_semi").distinct()
    sample = least_hashed(pinned(sample, "marked"), F.xxhash64(F.lit(seed), "doc_id"), target_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.withColumn("good", F.lit(1.0))), "doc_id", "left").select("text", F.coalesce("good", F.lit(0.0)).alias("good"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            texts, good = batch["text"].tolist(), batch["good"].to_numpy()
            for i, j in slices(texts):
                bucket, owner = ngrams(texts[i:j])
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket, good[i:j][owner], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": seen, "raw": raw[seen], "target": target[seen]})

    sums = rows.mapInPandas(count, "bucket long, raw double, target double").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[sums["bucket"]], target[sums["bucket"]] = sums["raw"], sums["target"]
    if not target.sum():
        return None
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def mean_ratio(ratio: np.ndarray, texts: Sequence[str | None]) -> np.ndarray:
    out = [np.zeros(0)]
    for i, j in slices(texts):
        bucket, owner = ngrams(texts[i:j])
        out.append(np.bincount(owner, ratio[bucket], minlength=j - i) / (np.bincount(owner, minlength=j - i) + SHRINK))
    return np.concatenate(out)


def log_weight(ratio: np.ndarray | None, text: Column | str) -> Column:
    if ratio is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(mean_ratio(ratio, batch.tolist()))

    return weigh(text)


def gumbel(seed: Column | int, *columns: str) -> Column:
    """Standard Gumbel noise that depends on the seed and the row's values alone."""
    u = (F.pmod(F.xxhash64(seed if isinstance(seed, Column) else F.lit(seed), *columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, k: int, bins: int = 4096, few: int = 8192) -> float:
    """The k-th largest of a double column `v`: histograms of ever smaller ranges, then at most `few` values."""
    lo, hi, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if k >= n:
        return lo
    while True:
        inside = values.where(F.col("v").between(lo, hi))
        width = (hi - lo) / bins
        if inside.limit(few + 1).count() <= few or width <= abs(hi) * 1e-15:
            above = values.where(F.col("v") > hi).count()
            held = inside.groupBy("v").count().orderBy(F.desc("v")).limit(few).collect()
            for row in held:
                above += row["count"]
                if above >= k:
                    return row["v"]
            return lo
        cells = inside.groupBy(F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy(F.desc("cell")).collect()
        above = values.where(F.col("v") > hi).count()
        for cell in cells:
            if above + cell["n"] >= k:
                lo, hi = cell["lo"], cell["hi"]
                break
            above += cell["n"]
        if lo == hi:
            return lo


def best_cut(lo: np.ndarray, hi: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The cut between ascending bins of weights, each from lo to hi with counts of good and bad, with the largest share
    of good at or above it less that of bad, in the middle of the gap below it."""
    if not good.sum() or not bad.sum():
        return float("-inf")
    above = lambda n: np.cumsum(n[::-1])[::-1] / n.sum()
    at = int(np.argmax(above(good) - above(bad)))
    return float(lo[at] if at == 0 else (hi[at - 1] + lo[at]) / 2)


def label_floor(weighted: DataFrame, labels: DataFrame, *, width: float = BIN) -> float:
    """The cut between weights (doc_id, w) of documents marked good and bad, by all that are marked.

    What comes to the driver are counts by bins of `width`: a weight is a mean of log ratios, so its bins grow with the
    logarithm of the corpus.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") > 0).cast("int")).alias("mark"))
    bins = weighted.join(marks, "doc_id").groupBy(F.floor(F.col("w") / width).alias("bin")).agg(F.min("w").alias("lo"), F.max("w").alias("hi"), F.sum("mark").alias("good"), F.sum(1 - F.col("mark")).alias("bad")).orderBy("bin").toPandas()
    return best_cut(*(bins[c].to_numpy(float) for c in ("lo", "hi", "good", "bad")))


def resample(docs: DataFrame, labels: DataFrame, *, keep: Sequence[str] = ("doc_id",), k: int | None = None, scale: float = SCALE, floor: float | None = None, share: float = SHARE, seed: int = 11) -> DataFrame:
    """(row, log_weight, gumbel_key, kept, sampled) for every row of docs, where row is a struct of the columns `keep`.

    Texts are read for the raw counts and once more for the weights, which are written with the kept columns.
    """
    weight = log_weight(fit_ratio(docs, labels), F.col("text"))
    rows = docs.select(F.struct(*keep).alias("row"), F.col("doc_id").alias("id"), weight.alias("w"), gumbel(seed, "doc_id", "text").alias("g"))
    keys = pinned(rows.withColumn("v", F.lit(scale) * F.col("w") + F.col("g")).drop("g"), "weights")
    if k is None:
        floor = label_floor(keys.select(F.col("id").alias("doc_id"), "w"), labels) if floor is None else floor
        k = keys.where(F.col("w") >= floor).count()
    least, drawn = (kth_largest(keys.select("v"), n) if n else float("inf") for n in (k, math.ceil(share * k)))
    reaches = lambda cut: F.coalesce(F.col("v") >= F.lit(cut), F.lit(True))
    return keys.select("row", F.col("w").alias("log_weight"), F.col("v").alias("gumbel_key"), reaches(least).alias("kept"), reaches(drawn).alias("sampled"))
