"""Hard-negative mining: each anchor's best positives, and for each of them the best negatives in a band below its score.

Components become floor(scale * x), so a score, the inner product, is an integer. Vectors are turned by an orthogonal
matrix whose leading columns are the principal directions (about 0) of a bounded sample: inner products stay as they
are, and their first partial sums say most. Products with leading components are added up level by level; the rest
is at most the product of the lengths of what is left of both vectors, plus a slack for rounding. A pair whose bound
can't reach what an anchor still needs, or is above its band, is discarded at once; the last survivors' scores are
computed from the integers. No sample, however bad, loses a result: it only makes bounds wider.

Anchors are dealt into chunks of at most CHUNK_CELLS components. A chunk is broadcast; every task goes through its
own rows twice, once for positives and once, these known, for negatives, and returns the few best of each anchor, which
are put together by anchor. No row is shuffled, no pair is one. Anchors times rows is the work by definition.

Defined cases: a row takes no part if its vec_id, label or vector is null, or a component is null or not finite, also
after scaling. Vectors of different lengths don't meet; empty ones have score 0. Other rows are those of another
vec_id; rows equal in vec_id, label and vector count once. A negative positive score leaves no band, so no negatives. A
score beyond 64 bits raises. An empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.runs import framed
from loomtext.llm.sampling import least_hashed
from loomtext.session import pinned

SAMPLE = 8_192
CHUNK_CELLS = 1 << 21
ROWS, ANCHORS = 4_096, 1_024
#: Shares of the components after which bounds are checked, and of pairs below which single pairs are followed.
LEVELS = (0.125, 0.25, 0.5, 0.75, 1.0)
SPARSE = 1 / 32
_VERIFY = 1 << 15
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_LOWEST = -(1 << 62)


def coded(vectors: DataFrame, anchor: Column, scale: float) -> DataFrame:
    """(vec_id, label, dim, v, anchor) of the rows that take part; v is the scaled vector's doubles."""

    def scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = []
            for x in batch["x"]:
                v = np.array([np.nan if c is None else c for c in x], np.float64)
                with np.errstate(over="ignore"):
                    v = np.floor(scale * v)
                values.append(v.tobytes() if np.isfinite(v).all() else None)
            batch = batch.assign(dim=[len(x) for x in batch["x"]], v=values).drop(columns="x")
            yield batch[batch["v"].notna()]

    able = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    rows = able.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), anchor.alias("anchor"), F.col("embedding").alias("x"))
    return rows.mapInPandas(scaled, "vec_id long, label string, anchor boolean, dim int, v binary")


def fit(rows: DataFrame, *, sample: int = SAMPLE, seed: int = 3) -> dict[int, np.ndarray]:
    """An orthogonal matrix for each dimension, leading directions first, from the `sample` rows of least hash; fitted in one task."""

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([*batches, pd.DataFrame({"dim": [], "v": []})])
        out = {}
        for dim, group in held.groupby("dim"):
            x = np.stack([np.frombuffer(v) for v in group["v"]])
            x = x / max(1.0, np.abs(x).max(initial=0))
            out[int(dim)] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
        yield pd.DataFrame({"model": [pickle.dumps(out)]})

    drawn = least_hashed(rows.where("dim > 0").select("dim", "v"), F.xxhash64(F.lit(seed), "v"), sample).coalesce(1)
    found = drawn.mapInPandas(fitted, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else {}


class Turned:
    """Vectors of one dimension beside their turned form and the lengths of what follows each level."""

    def __init__(self, raw: list[bytes], dim: int, matrix: np.ndarray | None):
        self.x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), dim)
        self.turned = self.x if matrix is None else self.x @ matrix
        self.cuts = sorted({max(1, int(dim * share)) for share in LEVELS}) if dim else []
        top = np.maximum(np.abs(self.turned).max(axis=1, initial=0), 1.0)[:, None]
        rest = np.cumsum(((self.turned / top) ** 2)[:, ::-1], axis=1)[:, ::-1]
        self.length = np.sqrt(rest[:, 0]) * top[:, 0] if dim else np.zeros(len(raw))
        self.rest = [np.sqrt(rest[:, c]) * top[:, 0] * (1 + 1e-9) if c < dim else np.zeros(len(raw)) for c in self.cuts]
        self.slack = 16 * (dim + 4) * 2.0**-53 * self.length

    def some(self, at: np.ndarray) -> Turned:
        out = object.__new__(Turned)
        out.x, out.turned, out.cuts, out.length, out.slack = self.x[at], self.turned[at], self.cuts, self.length[at], self.slack[at]
        out.rest = [r[at] for r in self.rest]
        return out


def survivors(q: Turned, r: Turned, allowed: np.ndarray | None, need: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of q, of r) among the allowed whose score can lie between q's `need` and `most`."""
    total = np.zeros((len(need), len(r.x)))
    a = b = t = None
    start = 0
    for level, cut in enumerate(q.cuts):
        if a is None:
            total += q.turned[:, start:cut] @ r.turned[:, start:cut].T
            reach = q.rest[level][:, None] * r.rest[level][None, :] + q.slack[:, None] * r.length[None, :]
            alive = (total + reach >= need[:, None]) & (total - reach <= most[:, None])
            if allowed is not None:
                alive &= allowed
            if np.count_nonzero(alive) <= SPARSE * alive.size:
                a, b = np.nonzero(alive)
                t = total[a, b]
        else:
            t = t + np.concatenate([np.zeros(0), *((q.turned[a[i : i + _VERIFY], start:cut] * r.turned[b[i : i + _VERIFY], start:cut]).sum(axis=1) for i in range(0, len(a), _VERIFY))])
            reach = q.rest[level][a] * r.rest[level][b] + q.slack[a] * r.length[b]
            kept = (t + reach >= need[a]) & (t - reach <= most[a])
            a, b, t = a[kept], b[kept], t[kept]
        start = cut
    if a is None:
        a, b = np.nonzero(alive) if q.cuts else np.nonzero(np.ones_like(total, bool) if allowed is None else allowed)
    return a, b


def scores(q: Turned, r: Turned, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact scores of pairs, as integer products."""
    out = [np.zeros(0, np.int64)]
    for i in range(0, len(a), _VERIFY):
        x, y = q.x[a[i : i + _VERIFY]], r.x[b[i : i + _VERIFY]]
        if q.length.max(initial=0) * r.length.max(initial=0) < 2.0**61:
            out.append((x.astype(np.int64) * y.astype(np.int64)).sum(axis=1))
        else:
            out.append(np.array([sum(int(u) * int(w) for u, w in zip(p, s)) for p, s in zip(x.tolist(), y.tolist())], object).astype(np.int64))
    return np.concatenate(out)


class Best:
    """The k best (score, id) of each slot: higher scores first, of equal ones the smaller id; each once."""

    def __init__(self, slots: int, k: int):
        self.slots, self.k = slots, k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.worst = np.full(slots, _LOWEST)  # the k-th score of full slots

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        new = np.concatenate([[True], (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])])
        slot, score, ids = slot[new], score[new], ids[new]
        first = np.concatenate([[True], slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0))
        kept = place < self.k
        self.slot, self.score, self.id = slot[kept], score[kept], ids[kept]
        full = place[kept] == self.k - 1
        self.worst[self.slot[full]] = self.score[full]


class Anchors:
    """A chunk of anchors of one dimension; once their positives are known, with a band for each."""

    def __init__(self, held: pd.DataFrame, dim: int, matrix: np.ndarray | None, positives: int):
        self.vectors = Turned(held["v"].tolist(), dim, matrix)
        self.node, self.id, self.label = held["node"].to_numpy(), held["vec_id"].to_numpy(), held["label"].to_numpy(object)
        self.positives = positives

    def bands(self, found: pd.DataFrame, low: int, high: int) -> None:
        """Bands (lo, hi) by anchor and rank of positive (node, place, score); empty where there is none."""
        n = len(self.node)
        self.lo, self.hi = np.full((n, self.positives), 1 << 62), np.full((n, self.positives), _LOWEST)
        at = pd.Series(np.arange(n), index=self.node)
        found = found[found["node"].isin(at.index)]
        score = found["score"].to_numpy().astype(object)
        row, place = at[found["node"]].to_numpy(), found["place"].to_numpy()
        self.lo[row, place], self.hi[row, place] = -((-low * score) // 100), (high * score) // 100


def positives_in(batch: pd.DataFrame, rows: Turned, anchors: Anchors, best: Best) -> None:
    labels, ids = batch["label"].to_numpy(object), batch["vec_id"].to_numpy()
    for label in pd.unique(labels):
        mine, theirs = np.flatnonzero(anchors.label == label), np.flatnonzero(labels == label)
        r = rows.some(theirs)
        for i in range(0, len(mine), ANCHORS):
            some = mine[i : i + ANCHORS]
            q = anchors.vectors.some(some)
            a, b = survivors(q, r, anchors.id[some][:, None] != ids[theirs][None, :], best.worst[some].astype(float), np.full(len(some), np.inf))
            best.add(some[a], scores(q, r, a, b), ids[theirs][b])


def negatives_in(batch: pd.DataFrame, rows: Turned, anchors: Anchors, best: Best) -> None:
    labels, ids = batch["label"].to_numpy(object), batch["vec_id"].to_numpy()
    for i in range(0, len(anchors.node), ANCHORS):
        some = np.arange(i, min(i + ANCHORS, len(anchors.node)))
        lo, hi = anchors.lo[some], anchors.hi[some]
        need = np.maximum(lo, best.worst.reshape(-1, anchors.positives)[some])
        open_ = lo <= hi
        least, most = np.where(open_, need, 1 << 62).min(axis=1), np.where(open_, hi, _LOWEST).max(axis=1)
        q = anchors.vectors.some(some)
        allowed = (anchors.label[some][:, None] != labels[None, :]) & (anchors.id[some][:, None] != ids[None, :]) & open_.any(axis=1)[:, None]
        a, b = survivors(q, rows, allowed, least.astype(float), most.astype(float))
        score = scores(q, rows, a, b)
        for place in range(anchors.positives):
            inside = (score >= lo[a, place]) & (score <= hi[a, place])
            best.add(some[a[inside]] * anchors.positives + place, score[inside], ids[b[inside]])


def _searched(rows: DataFrame, chunk: dict[int, Anchors], matrices: dict[int, np.ndarray], slots: int, k: int, visit) -> DataFrame:
    """(node, place, score, id): the k best of all rows in each slot of each anchor."""
    shared = rows.sparkSession.sparkContext.broadcast((chunk, matrices))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, matrices = shared.value
        best = {dim: Best(len(anchors.node) * slots, k) for dim, anchors in chunk.items()}
        for frame in framed(batches, ROWS):
            for dim, group in frame.groupby("dim"):
                if dim in chunk:
                    for i in range(0, len(group), ROWS):
                        some = group.iloc[i : i + ROWS]
                        visit(some, Turned(some["v"].tolist(), int(dim), matrices.get(int(dim))), chunk[dim], best[dim])
        for dim, found in best.items():
            yield pd.DataFrame({"node": chunk[dim].node[found.slot // slots], "place": (found.slot % slots).astype(np.int32), "score": found.score, "id": found.id})

    found = rows.select("vec_id", "label", "dim", "v").mapInPandas(search, "node long, place int, score long, id long")
    order = Window.partitionBy("node", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= k).dropDuplicates(["node", "place", "nth"])


def mine(vectors: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, chunk_cells: int = CHUNK_CELLS) -> DataFrame:
    """RESULT for the rows of vectors (vec_id, embedding, label) that `anchor` marks: for each of an anchor's first
    `positives` rows of its label, the first `negatives` rows of other labels whose score is from `low` to `high`
    hundredths of that positive's."""
    rows = pinned(coded(vectors, anchor, scale), "coded")
    matrices = fit(rows)
    asked = pinned(rows.where("anchor").groupBy("vec_id", "label", "dim", "v").count().select("vec_id", "label", "dim", "v", F.monotonically_increasing_id().alias("node")), "anchors")
    cells = asked.agg(F.sum(F.col("dim") + 1)).first()[0] or 0
    chunks = max(1, -(-cells // chunk_cells))
    out = []
    for c in range(chunks):
        held = asked.where(F.pmod(F.xxhash64("node"), F.lit(chunks)) == c).toPandas()  # about chunk_cells doubles
        chunk = {int(dim): Anchors(group, int(dim), matrices.get(int(dim)), positives) for dim, group in held.groupby("dim")}
        best = pinned(_searched(rows, chunk, matrices, 1, positives, positives_in), "positives")
        known = best.select("node", (F.col("nth") - 1).alias("place"), "score", "id")
        local = known.toPandas()
        for anchors in chunk.values():
            anchors.bands(local, low, high)
        found = _searched(rows, chunk, matrices, positives, negatives, negatives_in).select("node", "place", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"), F.col("nth").cast("int").alias("rank"))
        named = found.join(known.select("node", "place", F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), ["node", "place"])
        named = named.join(asked.select("node", F.col("vec_id").alias("anchor_id")), "node")
        named = named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out.append(pinned(named, "mined") if chunks > 1 else named)
    return reduce(DataFrame.unionByName, out)
