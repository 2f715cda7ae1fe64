"""Matrices as tiles and blocks of rows: checkpoints, products and the loss over a large vocabulary.

A tile is (name, i, j, rows, columns, values): the part of a matrix from row i * TILE and column j * TILE on, its doubles
row by row. A vector is a matrix of one row. No matrix is ever in one task or row, nor on the driver; what a task
holds at once is bounded by tiles. Numbers that are null or not finite stay as they are: nulls become NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators.model import BUFFERS, TRANSPOSED
from loomtext.session import pinned, small_side

TILE = 256
TILES = "name string, i int, j int, rows int, columns int, values binary"
#: Cells that a task sums up before it sends them on.
SUMMED = 1 << 22


def _tile(row) -> np.ndarray:
    return np.frombuffer(row.values, np.float64).reshape(row.rows, row.columns)


def _frame(name: list, found: list[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({"name": name, "i": [i for i, _, _ in found], "j": [j for _, j, _ in found], "rows": [len(x) for _, _, x in found], "columns": [x.shape[1] for _, _, x in found], "values": [x.astype(np.float64).tobytes() for _, _, x in found]})


def from_rows(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """TILES of matrices given as (name, row, values array<double>), rows from 0 and of equal length; a row goes to its
    tiles in slices. Repeated rows raise."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("values") - 1) / tile).cast("int")), lambda j: F.struct(j.alias("j"), F.slice("values", j * tile + 1, F.lit(tile)).alias("x")))
    cut = rows.where(F.size("values") > 0).select("name", F.floor(F.col("row") / tile).cast("int").alias("i"), "row", F.explode(parts).alias("e")).select("name", "i", "e.j", "row", "e.x")

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        if group["row"].duplicated().any() or (group["row"].to_numpy() % tile != np.arange(len(group))).any():
            raise ValueError(f"a row of {group['name'].iloc[0]} is missing or there twice")
        return _frame([group["name"].iloc[0]], [(group["i"].iloc[0], group["j"].iloc[0], np.stack(group["x"].to_list()).astype(np.float64))])

    return cut.groupBy("name", "i", "j").applyInPandas(gather, TILES)


def entries(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """(name, row, j, values): each tile's rows as arrays, row numbers those of the matrix."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield pd.DataFrame({"name": row.name, "row": row.i * tile + np.arange(row.rows), "j": row.j, "values": list(_tile(row))})

    return tiles.mapInPandas(split, "name string, row long, j int, values array<double>")


def changed(tiles: DataFrame, change: Callable[[str, np.ndarray, int, int], tuple[int, int, np.ndarray]]) -> DataFrame:
    """Every tile as change(name, values, i, j) gives it: (i, j, values)."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield _frame(batch["name"].tolist(), [change(row.name, _tile(row), row.i, row.j) for row in batch.itertuples()])

    return tiles.select("name", "i", "j", "rows", "columns", "values").mapInPandas(apply, TILES)


def transposed(tiles: DataFrame) -> DataFrame:
    return changed(tiles, lambda _, x, i, j: (j, i, x.T))


def match_checkpoint(own: DataFrame, stored: DataFrame, tile: int = TILE) -> DataFrame:
    """Stored tiles in the layout of own's (name, shape): four kinds of weights turned, buffers left out.

    Only the extents of tiles are compared, one row for each weight; a weight without its match in name or shape, with
    a tile missing or there twice raises. Turning swaps a tile's numbers and turns it.
    """
    ends = lambda c: F.exists(F.array(*map(F.lit, c)), lambda s: F.endswith("name", s))
    kept = stored.where(~ends(BUFFERS))
    extent = lambda i, n: F.max(F.col(i) * tile + F.col(n))
    found = kept.groupBy("name").agg(extent("i", "rows").alias("r"), extent("j", "columns").alias("c"), F.sum((F.col("rows") * F.col("columns")).cast("long")).alias("cells"), F.count("*").alias("n"), F.countDistinct("i", "j").alias("places"))
    shape = F.when(ends(TRANSPOSED), F.array("c", "r")).otherwise(F.array("r", "c"))
    wanted = F.when(F.size("shape") == 1, F.concat(F.array(F.lit(1)), "shape")).otherwise(F.col("shape"))
    both = own.where(~ends(BUFFERS)).select("name", "shape").join(found, "name", "full_outer")
    wrong = both.where(~(wanted.eqNullSafe(shape) & (F.col("cells") == F.col("r").cast("long") * F.col("c")) & (F.col("n") == F.col("places"))) | F.col("shape").isNull() | F.col("cells").isNull())
    names = [r["name"] for r in wrong.select("name").orderBy("name").limit(3).collect()]
    if names:
        raise ValueError(f"no match for {', '.join(names)}")
    return changed(kept, lambda name, x, i, j: (j, i, x.T) if name.endswith(TRANSPOSED) else (i, j, x))


def _summed(partials: DataFrame, name: str) -> DataFrame:
    """Tiles summed by place: those of one place follow each other in a sorted partition."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, held = None, None
        for batch in batches:
            for row in batch.itertuples():
                if (row.i, row.j) == place:
                    held = held + _tile(row)
                    continue
                if place is not None:
                    yield _frame([name], [(*place, held)])
                place, held = (row.i, row.j), _tile(row)
        if place is not None:
            yield _frame([name], [(*place, held)])

    return partials.repartition("i", "j").sortWithinPartitions("i", "j").mapInPandas(add, TILES)


def product(left: DataFrame, right: DataFrame, name: str = "product") -> DataFrame:
    """Tiles of the product of two matrices given as tiles, which meet by the inner index.

    The right one is broadcast if it is measured to be small; else both are shuffled by the inner index. A task adds up
    the partial products of a place before it sends them on, so what is shuffled then follows tasks and results.
    Both should be written tables: the widths of their tiles are read first, to see that columns meet rows.
    """
    inner = left.groupBy(F.col("j").alias("k")).agg(F.max("columns").alias("inner"))
    deep = right.groupBy(F.col("i").alias("k")).agg(F.max("rows").alias("deep"))
    wrong = inner.join(deep, "k", "full_outer").where("NOT inner <=> deep").first()
    if wrong is not None and not left.isEmpty():
        raise ValueError(f"{wrong['inner']} columns meet {wrong['deep']} rows at the inner index {wrong['k']}")
    a = left.select("i", F.col("j").alias("k"), F.col("rows").alias("n"), F.col("columns").alias("inner"), F.col("values").alias("x"))
    b = small_side(right.select(F.col("i").alias("k"), "j", F.col("rows").alias("deep"), F.col("columns").alias("m"), F.col("values").alias("y")))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        cells = 0
        for batch in batches:
            for row in batch.itertuples():
                x = np.frombuffer(row.x, np.float64).reshape(row.n, row.inner) @ np.frombuffer(row.y, np.float64).reshape(row.deep, row.m)
                if (row.i, row.j) in held:
                    held[row.i, row.j] += x
                else:
                    held[row.i, row.j] = x
                    cells += x.size
                if cells >= SUMMED:
                    yield _frame([name] * len(held), [(*place, v) for place, v in held.items()])
                    held, cells = {}, 0
        if held:
            yield _frame([name] * len(held), [(*place, v) for place, v in held.items()])

    return _summed(a.join(b, "k").mapInPandas(multiply, TILES), name)


def row_norms(tiles: DataFrame, tile: int = TILE, epsilon: float = 1e-5) -> DataFrame:
    """(row, mean, scale) for the layer norm of each row, from sums that its tiles give apart."""
    sums = entries(tiles, tile).select("row", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda s, v: s + v).alias("s"), F.aggregate("values", F.lit(0.0), lambda s, v: s + v * v).alias("q"))
    mean = F.sum("s") / F.sum("n")
    return sums.groupBy("row").agg(mean.alias("mean"), (1 / F.sqrt(F.greatest(F.sum("q") / F.sum("n") - mean * mean, F.lit(0.0)) + epsilon)).alias("scale"))


def with_bias(tiles: DataFrame, bias: DataFrame, after: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Tiles plus a vector's tiles, column by column, and then a function of each number, if one is given."""
    b = small_side(bias.select("j", F.col("values").alias("bias")))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = [(row.i, row.j, _tile(row) + np.frombuffer(row.bias, np.float64)) for row in batch.itertuples()]
                yield _frame(batch["name"].tolist(), [(i, j, after(x) if after else x) for i, j, x in found])

    return tiles.join(b, "j").select("name", "i", "j", "rows", "columns", "values", "bias").mapInPandas(add, TILES)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def added(left: DataFrame, right: DataFrame, name: str = "sum") -> DataFrame:
    return _summed(left.unionByName(right), name)


def vocabulary_loss(states: DataFrame, tokens: DataFrame, *, state_block: int = 4_096, token_block: int = 8_192, at_once: int = 512) -> DataFrame:
    """(row, loss): cross-entropy of states (row, x, target) over all tokens (token, x), logits being dot products.

    States and tokens are dealt into blocks. A task goes through one block of each in stretches of `at_once` tokens and
    keeps of a state the largest logit, the sum of the exponentials below it and the target's logit; the few such rows
    of a state are put together by the largest of all. No row of logits exists, and memory is that of two blocks,
    whatever the vocabulary. A state of null target, or of one that isn't a token, has loss null.
    """
    s, t = (max(1, -(-df.count() // n)) for df, n in ((states, state_block), (tokens, token_block)))
    left = states.select("row", "x", "target", F.pmod(F.xxhash64("row"), F.lit(s)).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(t - 1))).alias("t"))
    right = tokens.select("token", F.col("x").alias("y"), F.pmod(F.xxhash64("token"), F.lit(t)).cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(s - 1))).alias("s"))

    def part(states: pd.DataFrame, tokens: pd.DataFrame) -> pd.DataFrame:
        if not len(states) or not len(tokens):
            return pd.DataFrame({"row": [], "top": [], "weight": [], "own": []})
        x, y = np.stack(states["x"].to_list()), np.stack(tokens["y"].to_list())
        top, weight = np.full(len(x), -np.inf), np.zeros(len(x))
        for i in range(0, len(y), at_once):
            logits = x @ y[i : i + at_once].T
            high = np.maximum(top, logits.max(axis=1))
            weight = weight * np.exp(top - high) + np.exp(logits - high[:, None]).sum(axis=1)
            top = high
        place = pd.Series(np.arange(len(y)), index=tokens["token"]).reindex(states["target"]).to_numpy(float)
        own = np.full(len(x), np.nan)
        mine = np.flatnonzero(~np.isnan(place))
        own[mine] = (x[mine] * y[place[mine].astype(int)]).sum(axis=1)
        return pd.DataFrame({"row": states["row"], "top": top, "weight": weight, "own": own})

    found = left.groupBy("s", "t").cogroup(right.groupBy("s", "t")).applyInPandas(part, "row long, top double, weight double, own double")
    held = found.groupBy("row").agg(F.max("top").alias("high"), F.collect_list(F.struct("top", "weight")).alias("parts"), F.max(F.when(~F.isnan("own"), F.col("own"))).alias("own"))
    total = F.aggregate("parts", F.lit(0.0), lambda w, e: w + e["weight"] * F.exp(e["top"] - F.col("high")))
    return held.select("row", (F.col("high") + F.log(total) - F.col("own")).alias("loss"))


def mlp(states: DataFrame, weights: DataFrame, layer: int = 0) -> DataFrame:
    """Tiles of x + W2 gelu(W1 norm(x) + b1) + b2, the second half of a layer, of states' tiles and a model's (name, ...) tiles.

    Each step is written, so a lost task repeats its own step only.
    """
    of = lambda kind: weights.where(F.col("name") == f"transformer.h.{layer}.{kind}")
    norms = pinned(row_norms(states), "norms")
    rows = entries(states).join(norms, "row").select(F.lit("x").alias("name"), "row", "j", F.transform("values", lambda v: (v - F.col("mean")) * F.col("scale")).alias("values"))
    normed = pinned(scaled_columns(rows, of("ln_2.weight"), of("ln_2.bias")), "normed")
    hidden = pinned(with_bias(product(normed, transposed(of("mlp.c_fc.weight"))), of("mlp.c_fc.bias"), gelu), "hidden")
    out = pinned(with_bias(product(hidden, transposed(of("mlp.c_proj.weight"))), of("mlp.c_proj.bias")), "out")
    return added(states, out)


def scaled_columns(rows: DataFrame, weight: DataFrame, bias: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles of rows' slices (name, row, j, values), each column scaled and shifted by two vectors."""
    vectors = small_side(weight.select("j", F.col("values").alias("w")).join(bias.select("j", F.col("values").alias("b")), "j"))

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        w, b = (np.frombuffer(group[c].iloc[0], np.float64) for c in ("w", "b"))
        return _frame([group["name"].iloc[0]], [(int(group["row"].iloc[0]) // tile, int(group["j"].iloc[0]), np.stack(group["values"].to_list()) * w + b)])

    return rows.join(vectors, "j").withColumn("i", F.floor(F.col("row") / tile)).groupBy("name", "i", "j").applyInPandas(gather, TILES)
