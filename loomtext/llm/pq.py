"""Embedding near-duplicates by product quantisation within inverted lists, with exact cosine rerank.

Vectors of one label and dimension are compared. A coarse quantiser, fitted on a bounded sample, gives each vector a
home list, where it is held as the codes of its residual's subspaces and the length of what the codes miss.
A vector probes every list from its home on, by number, that can hold a neighbour; those before it are probed from
the other side, so that a pair of two lists meets once: with cosine >= t, unit vectors are at most r = sqrt(2 - 2t)
apart, so the neighbour's home is no farther than r beyond the plane between the two centroids. In a list, table
lookups give the distance to each coded vector; those within r plus what that code misses are candidates, and their
cosine is computed from the vectors. Neither step can lose a link, whatever the sample. There are as many lists as the
largest label has LIST_ROWS vectors: fewer, larger ones would look up more, more of them would be probed more often.

Vectors that are equal as unit vectors are one class, compared once. Tasks return link counts and spanning forests,
never pairs; lists over a block are cut into a grid of blocks.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and those of null label, link
with nothing. Repeated rows are copies of each other. A null vec_id has a null component of its own unless it links. An empty table gives
an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.components import Forest, components
from loomtext.llm.runs import crossing, dealt, gridded, runs
from loomtext.llm.sampling import least_hashed
from loomtext.session import pinned

COSINE = 0.98
SAMPLE = 20_000
MAX_LISTS = 1024
LIST_ROWS = 4096
SUBSPACES = 8
CODES = 64
BLOCK = 8192
ASK = 256
_SLACK = 1e-6
_LOOKUP_SLACK = 1e-3  # lookups add single-precision numbers


def units(vectors: list) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for those that can't link."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None if v is None or len(v) == 0 else np.array([np.nan if c is None else c for c in v] if getattr(v, "dtype", object) == object else v, np.float64)
        if x is not None and np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
            x = x / top  # so that neither tiny nor huge components over- or underflow
            out.append(x / np.sqrt((x * x).sum()))
        else:
            out.append(None)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, d], minlength=len(centres)) for d in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)


class Quantiser:
    """Coarse centroids and residual codebooks of one dimension."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = kmeans(sample, max(1, min(lists, len(sample))))
        residual = sample - self.centres[nearest(sample, self.centres)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [kmeans(residual[:, p], min(CODES, len(sample))) for p in self.parts]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, what the codes miss)."""
        home = nearest(x, self.centres)
        rest = x - self.centres[home]
        codes = np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books)], axis=1)
        for j, (p, b) in enumerate(zip(self.parts, self.books)):
            rest[:, p] -= b[codes[:, j]]
        return home, codes.astype(np.uint8), np.sqrt((rest**2).sum(axis=1))

    def probes(self, x: np.ndarray, home: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for all lists, after each row's home, that a vector within `radius` can have as its home."""
        square = (x**2).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1)[None, :] - 2 * x @ self.centres.T
        norms = (self.centres**2).sum(axis=1)
        apart = np.sqrt(np.maximum(0, norms[home][:, None] + norms[None, :] - 2 * self.centres[home] @ self.centres.T))
        within = square - square[np.arange(len(x)), home][:, None] <= 2 * radius * apart + _SLACK
        return np.nonzero(within & (np.arange(len(self.centres))[None, :] > home[:, None]))

    def near(self, queries: np.ndarray, cell: int, codes: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Whether the asymmetric distance, by table lookup, of each query to each coded vector is within its reach."""
        rest = queries - self.centres[cell]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for j, (p, b) in enumerate(zip(self.parts, self.books)):
            table = (rest[:, p] ** 2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * rest[:, p] @ b.T
            total += np.take(table.astype(np.float32), codes[:, j], axis=1)
        return total <= ((reach + _LOOKUP_SLACK) ** 2).astype(np.float32)[None, :]


def fit(classes: DataFrame, *, sample: int = SAMPLE, list_rows: int = LIST_ROWS, seed: int = 1) -> dict[int, Quantiser]:
    """Quantisers by dimension, from the `sample` vectors with the least seeded hash; fitted in one task."""
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    lists = int(min(MAX_LISTS, max(1, -(-largest // list_rows))))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([*batches, pd.DataFrame({"dim": [], "unit": []})])
        out = {int(d): Quantiser(np.stack([np.frombuffer(u) for u in g["unit"]]), lists) for d, g in held.groupby("dim")}
        yield pd.DataFrame({"model": [pickle.dumps(out)]})

    drawn = least_hashed(classes.select("dim", "unit"), F.xxhash64(F.lit(seed), "unit"), sample).coalesce(1)
    found = drawn.mapInPandas(fitted, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else {}


def near_duplicates(vectors: DataFrame, *, cosine: float = COSINE, block: int = BLOCK, list_rows: int = LIST_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label)."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + _SLACK

    def normalised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = units(batch["embedding"].tolist())
            raw = [None if u is None else u.tobytes() for u in found]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "dim": [0 if u is None else len(u) for u in found], "unit": raw, "digest": [None if r is None else hashlib.md5(r).digest() for r in raw]})

    texted = vectors.select(F.col("vec_id").cast("string").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    rows = pinned(texted.mapInPandas(normalised, "vec_id string, label string, dim int, unit binary, digest binary").withColumn("vec_id", F.col("vec_id").cast("long")), "units")
    able = rows.where("unit IS NOT NULL AND label IS NOT NULL")
    classes = able.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("unit").alias("unit"))
    classes = pinned(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    models = fit(classes, list_rows=list_rows)
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each class once in its home list, with its codes, and once, as a guest, in each list after it that it probes."""
        for batch in batches:
            for dim, group in batch.groupby("dim"):
                model = shared.value.get(int(dim)) or Quantiser(np.zeros((1, int(dim))), 1)
                x = np.stack([np.frombuffer(u) for u in group["unit"]])
                home, codes, missed = model.place(x)
                yield group.assign(cell=home, guest=False, codes=[c.tobytes() for c in codes], missed=missed)
                row, cell = model.probes(x, home, radius)
                yield group.iloc[row].assign(cell=cell, guest=True, codes=b"", missed=0.0)

    places = classes.select("label", "dim", "node", "copies", "unit").mapInPandas(placed, "label string, dim int, node long, copies long, unit binary, cell int, guest boolean, codes binary, missed double")
    key = ["label", "dim", "cell"]
    spread = gridded(pinned(places, "places"), key, "node", block=block, few=True)
    cells = [*key, "lo", "hi"]

    def match(frame: pd.DataFrame, bounds: np.ndarray) -> Iterator[pd.DataFrame]:
        forest = Forest()
        links = np.zeros(len(frame), np.int64)
        node, own, guest, copies = (frame[c].to_numpy() for c in ("node", "own", "guest", "copies"))
        lo, hi, missed = frame["lo"].to_numpy(), frame["hi"].to_numpy(), frame["missed"].to_numpy()
        for s, e in zip(bounds[:-1], bounds[1:]):
            rows = np.concatenate([s + np.flatnonzero(~guest[s:e]), s + np.flatnonzero(guest[s:e])])
            held = int((~guest[s:e]).sum())
            if not held or e - s < 2:
                continue
            dim, cell = int(frame["dim"].iloc[s]), int(frame["cell"].iloc[s])
            model = shared.value.get(dim) or Quantiser(np.zeros((1, dim)), 1)
            unit = np.stack([np.frombuffer(u) for u in frame["unit"].iloc[rows]])
            codes = np.stack([np.frombuffer(c, np.uint8) for c in frame["codes"].iloc[rows[:held]]]).astype(np.intp)
            reach = radius + missed[rows[:held]]
            # Rows at home ask those after them only, guests all at home; no chunk holds both.
            asks = [(i, min(i + ASK, held), i + 1) for i in range(0, held, ASK)] + [(i, min(i + ASK, len(rows)), 0) for i in range(held, len(rows), ASK)]
            for i, end, first in asks:
                if first >= held:
                    continue
                a, b = np.nonzero(model.near(unit[i:end], cell, codes[first:], reach[first:]))
                a, b = a + i, b + first
                wanted = ((a >= held) | (b > a)) & crossing(own[rows[a]], own[rows[b]], lo[s], hi[s])
                a, b = a[wanted], b[wanted]
                exact = np.concatenate([np.zeros(0), *((unit[a[k : k + 50_000]] * unit[b[k : k + 50_000]]).sum(axis=1) for k in range(0, len(a), 50_000))])
                a, b = rows[a[exact >= cosine]], rows[b[exact >= cosine]]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                forest.link(zip(node[a].tolist(), node[b].tolist()))
        edges = forest.frame()
        edges["links"] = pd.Series(pd.NA, index=edges.index, dtype="Int64")
        yield edges
        yield pd.DataFrame({"a": node[links > 0], "b": node[links > 0], "links": pd.array(links[links > 0], dtype="Int64")})

    wide = spread.select("node", "copies", "unit", "guest", "codes", "missed", "own", *cells)
    found = pinned(dealt(wide, cells).mapInPandas(lambda b: runs(b, cells, match), "a long, b long, links long"), "found")
    links = found.where("links IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("links IS NULL").select("a", "b"))
    ids = roots.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("component_id"))
    about = classes.select("label", "dim", "digest", "node", "rep", "copies").join(roots.join(ids, "root").select("node", "component_id"), "node", "left").join(links, "node", "left")
    about = about.select("label", "dim", "digest", F.coalesce("component_id", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = rows.select("vec_id", "label", "dim", "digest").where("digest IS NOT NULL AND label IS NOT NULL").join(about, ["label", "dim", "digest"])
    # Vectors that can't link stay out of the join, where their nulls would be one key.
    alone = rows.where("digest IS NULL OR label IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = named.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
