"""Toxicity as ordinal regression: a cumulative-link model over sparse text features.

P(grade >= k) = sigmoid(w . x - theta_k), k = 1..K-1, with one weight vector for all thresholds and
theta ascending. x marks which hashed words and word beginnings a text has, however long it is.
The score is the expected severity, sum_k P(grade >= k), between 0 and K - 1.

The labels know two grades. The graded severity of a toxic text is therefore made here, out of how many marker
features it holds (`severity_grades`), markers being found in other texts than those that they grade. Tests hold the
0/1 decision against labels, the fit against the grades given, and severities against planted densities.

Defined cases: a null or empty text has no features, so its severity is that of the thresholds alone
(near 0). Without labelled rows of both kinds (an empty table, say) there is no model, and every severity is 0.
Repeated rows get equal scores, and count once in the fit; rows that share a doc_id but not the text are fitted apart.
Extra columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.sampling import least_hashed
from loomtext.llm.tokens import slices, token_hashes
from loomtext.session import pinned

PREFIXES = (3, 4, 5)
DIMENSIONS = 1 << 18
FOLDS = 10
SAMPLE_PER_CLASS = 4000
REJECT_FROM = 0.4


@dataclass
class OrdinalModel:
    weights: np.ndarray  # float32 of DIMENSIONS
    thresholds: np.ndarray  # ascending

    def expected_severity(self, scores: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))).sum(axis=1)


def features(texts: Sequence[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text number) pairs, each once: the hashed words and word beginnings of every text, or those `wanted` by a mask."""
    words, bounds, *starts = token_hashes(texts, prefixes=PREFIXES)
    owner = np.tile(np.repeat(np.arange(len(texts)), np.diff(bounds)), 1 + len(starts))
    slots = (np.concatenate([words, *starts]) % np.uint64(DIMENSIONS)).astype(np.int64)
    if wanted is not None:
        known = wanted[slots]
        slots, owner = slots[known], owner[known]
    pairs = np.unique(owner * DIMENSIONS + slots)
    return pairs % DIMENSIONS, pairs // DIMENSIONS


def likelihood_gain(with_high: np.ndarray, with_low: np.ndarray, high: int, low: int) -> np.ndarray:
    """The G statistic of each feature's 2 x 2 table, 0 for those that are rarer among high grades."""
    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)

    have = with_high + with_low
    n = max(1, high + low)
    tables = part(with_high, have * high / n) + part(with_low, have * low / n) + part(high - with_high, (n - have) * high / n) + part(low - with_low, (n - have) * low / n)
    return np.where(with_high * low > with_low * high, 2 * tables, 0)


def fit_ordinal(slots: np.ndarray, owner: np.ndarray, grades: np.ndarray, *, rounds: int = 1500, rate: float = 0.5, l1: float = 1e-4, least_gain: float = 12.0, keep: int = 4096) -> OrdinalModel:
    """Full-batch Adagrad with an L1 step, over at most `keep` features that speak for a grade above 0.

    A feature speaks for it if it is more frequent there by a likelihood-ratio statistic of `least_gain`.
    Weights stay at 0 or above: ordinary words never excuse a text, so its length doesn't either.
    """
    n, kinds = len(grades), int(grades.max()) + 1
    high = grades > 0
    with_high = np.bincount(slots[high[owner]], minlength=DIMENSIONS).astype(float)
    with_low = np.bincount(slots[~high[owner]], minlength=DIMENSIONS).astype(float)
    gain = likelihood_gain(with_high, with_low, int(high.sum()), int((~high).sum()))
    chosen = np.argsort(-gain, kind="stable")[:keep]
    chosen = chosen[gain[chosen] >= least_gain]
    place = np.full(DIMENSIONS, -1)
    place[chosen] = np.arange(len(chosen))
    column = place[slots]
    column, row = column[column >= 0], owner[column >= 0]
    w, theta = np.zeros(len(chosen)), 1.0 + 2.0 * np.arange(kinds - 1)
    seen_w, seen_t = np.full(len(chosen), 1e-3), np.full(kinds - 1, 1e-3)
    above = grades[:, None] > np.arange(kinds - 1)[None, :]
    each = np.full(n, 1 / n)
    for _ in range(rounds):
        score = np.bincount(row, w[column], minlength=n)
        # Between its two thresholds a grade's likelihood is a difference of sigmoids; outside, one of them is constant.
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -50, 50)))
        full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        slope = full * (1 - full)
        index = np.arange(n)
        mass = np.maximum(full[index, grades] - full[index, grades + 1], 1e-9)
        pull = (slope[index, grades] - slope[index, grades + 1]) / mass * each
        grad_w = -np.bincount(column, pull[row], minlength=len(w))
        up = np.where(above & (np.arange(kinds - 1)[None, :] == grades[:, None] - 1), p * (1 - p), 0)
        down = np.where(~above & (np.arange(kinds - 1)[None, :] == grades[:, None]), p * (1 - p), 0)
        grad_t = ((up - down) / mass[:, None] * each[:, None]).sum(axis=0)
        seen_w += grad_w**2
        seen_t += grad_t**2
        w = np.maximum(0, w - rate * (grad_w + l1) / np.sqrt(seen_w))
        theta = theta - rate * grad_t / np.sqrt(seen_t)
        theta = np.maximum.accumulate(theta - 0.2 * np.arange(kinds - 1)) + 0.2 * np.arange(kinds - 1)  # apart, so no grade's mass is 0
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[chosen] = w
    return OrdinalModel(weights, theta)


def severity_grades(slots: np.ndarray, owner: np.ndarray, toxic: np.ndarray, fold: np.ndarray, steps: Sequence[int] = (6, 12)) -> np.ndarray:
    """Grades 0..3 out of a 0/1 mark: a toxic text is graded by how many marker features of the other folds it holds.

    A marker is a feature at least e^2 times as frequent among toxic texts, and clearly so, in the texts of all folds but
    one; it grades those of that one, so no text has a say in what marks it. Folds whose rest lacks toxic or other
    texts leave their toxic texts at grade 1.
    """
    high = toxic > 0
    count = lambda rows: np.bincount(slots[rows[owner]], minlength=DIMENSIONS).astype(float)
    all_high, all_low = count(high), count(~high)
    hits = np.zeros(len(toxic))
    for k in np.unique(fold):
        mine = fold == k
        n_high, n_low = int((high & ~mine).sum()), int((~high & ~mine).sum())
        if n_high and n_low:
            with_high, with_low = all_high - count(high & mine), all_low - count(~high & mine)
            odds = np.log((with_high + 0.5) / (n_high + 1)) - np.log((with_low + 0.5) / (n_low + 1))
            marker = (odds > 2) & (likelihood_gain(with_high, with_low, n_high, n_low) >= 12)
            hits[mine] = np.bincount(owner, marker[slots], minlength=len(toxic))[mine]
    return np.where(high, 1 + (hits >= steps[0]) + (hits >= steps[1]), 0)


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = SAMPLE_PER_CLASS, seed: int = 7) -> OrdinalModel | None:
    """The model from labelled texts: at most `per_class` distinct texts of either mark, the least by a seeded hash.

    That bound keeps the fit in one task. Labels of one document that disagree count as toxic.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("mark"))
    keyed = pinned(docs.select("doc_id", F.xxhash64(F.lit(seed), "text").alias("h")).join(marks, "doc_id").groupBy("h").agg(F.max("mark").alias("mark"), F.min("doc_id").alias("doc_id")), "labelled")
    sample = [least_hashed(keyed.where(F.col("mark") == m), F.col("h"), per_class) for m in (0, 1)]
    picked = F.broadcast(sample[0].unionByName(sample[1]))
    # One row for each picked text, whatever other texts share its doc_id; of texts with one hash the least.
    hashed = docs.select("doc_id", "text", F.xxhash64(F.lit(seed), "text").alias("h"))
    texts = hashed.join(picked, ["doc_id", "h"]).groupBy("h", "mark").agg(F.min("text").alias("text")).select("h", "text", "mark")

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["text"].tolist()
            for i, j in slices(values):
                slots, owner = features(values[i:j])
                ends = np.searchsorted(owner, np.arange(j - i + 1))
                yield pd.DataFrame({"h": batch["h"].iloc[i:j], "mark": batch["mark"].iloc[i:j], "slots": [slots[ends[k] : ends[k + 1]].astype(np.int32).tobytes() for k in range(j - i)]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"h": [], "mark": [], "slots": []})])
        toxic = rows["mark"].to_numpy(np.int64)
        if len(set(toxic)) < 2:
            return
        sets = [np.frombuffer(s, np.int32) for s in rows["slots"]]
        slots, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        yield pd.DataFrame({"model": [pickle.dumps(fit_ordinal(slots, owner, severity_grades(slots, owner, toxic, np.mod(rows["h"].to_numpy(np.int64), FOLDS))))]})

    sample = texts.mapInPandas(marked, "h long, mark int, slots binary")
    found = sample.repartition(1).sortWithinPartitions("h", "slots").mapInPandas(fit, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else None


def score_texts(model: OrdinalModel, texts: Sequence[str | None]) -> np.ndarray:
    out, weighty = [np.zeros(0)], model.weights != 0
    for i, j in slices(texts):
        slots, owner = features(texts[i:j], weighty)
        out.append(model.expected_severity(np.bincount(owner, model.weights[slots], minlength=j - i)))
    return np.concatenate(out)


def severity(model: OrdinalModel | None, text):
    """Column: the expected severity of a text column."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(score_texts(model, batch.tolist()))

    return score(text)
