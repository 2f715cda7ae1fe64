"""Causal attention and the tied output head over large tables, block by block (NumPy in tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import kernels as K
from loomtext.session import ARROW_BYTES, pinned, small_batches

BLOCK, TOKENS = 512, 1_024


def causal(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(vec_id, keys, mixed) of rows (label, pos, vec_id, x): each position over itself and those before it in its label.

    A label's positions are cut into blocks; a task gets one block of queries and one of keys and returns, for each
    query, the largest score, the sum of weights and the weighted sum of values. Those few rows are put together by
    query, each rescaled to the largest score of all, so no task holds a label and no pair is a row.
    """
    own = F.floor(F.col("pos") / block).cast("int")
    last = rows.groupBy("label").agg(F.max(own).alias("last"))
    placed = rows.withColumn("own", own).join(last, "label")
    asks = placed.withColumn("asks", F.lit(True)).withColumn("cell", F.explode(F.expr("transform(sequence(0, own), k -> struct(own AS q, k AS k))")))
    keys = placed.withColumn("asks", F.lit(False)).withColumn("cell", F.explode(F.expr("transform(sequence(own, last), q -> struct(q AS q, own AS k))")))
    cells = asks.unionByName(keys).select("label", "cell.q", "cell.k", "asks", "pos", "vec_id", "x")

    def part(group: pd.DataFrame) -> pd.DataFrame:
        ask, key = group[group["asks"]], group[~group["asks"]]
        q, k = np.stack(ask["x"].to_list()), np.stack(key["x"].to_list())
        seen = key["pos"].to_numpy()[None, :] <= ask["pos"].to_numpy()[:, None]
        score = np.where(seen, q @ k.T / np.sqrt(q.shape[1]), -np.inf)
        top = score.max(axis=1)
        weight = np.where(seen, np.exp(score - top[:, None]), 0)
        return pd.DataFrame({"vec_id": ask["vec_id"], "keys": seen.sum(axis=1), "top": top, "weight": weight.sum(axis=1), "value": list(weight @ k)})

    found = cells.groupBy("label", "q", "k").applyInPandas(part, "vec_id long, keys long, top double, weight double, value array<double>")
    one = F.collect_list(F.struct("top", "weight", "value")).alias("parts")
    joined = found.groupBy("vec_id").agg(F.sum("keys").alias("keys"), F.max("top").alias("best"), one)
    scaled = F.transform("parts", lambda e: F.struct((e["weight"] * F.exp(e["top"] - F.col("best"))).alias("w"), F.transform(e["value"], lambda v: v * F.exp(e["top"] - F.col("best"))).alias("v")))
    sums = joined.select("vec_id", "keys", scaled.alias("parts"))
    value = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.get("parts", F.lit(0))["v"], lambda s, e: K.add(s, e["v"]))
    weight = K.total(F.transform("parts", lambda e: e["w"]))
    return sums.select("vec_id", "keys", K.bind(weight, lambda w: F.transform(value, lambda v: v / w)).alias("mixed"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(ids, vectors) of rows (id, x): blocks of at most `size` rows of a task, each one row of two byte strings."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def block() -> pd.DataFrame:
            some = pd.concat(held, ignore_index=True).sort_values("id", ignore_index=True)
            held.clear()
            return pd.DataFrame({"ids": [some["id"].to_numpy(np.int64).tobytes()], "vectors": [np.stack(some["x"].to_list()).astype(np.float64).tobytes()]})

        for batch in batches:
            while len(batch):
                room = size - sum(map(len, held))
                held.append(batch[:room])
                batch = batch[room:]
                if len(held[-1]) == room:
                    yield block()
        if held:
            yield block()

    return rows.mapInPandas(pack, "ids binary, vectors binary")


def likeliest(states: DataFrame, tokens: DataFrame, *, state_block: int = 4_096, token_block: int = 32_768) -> DataFrame:
    """(vec_id, token, logit): for each state (vec_id, x) the token (token, x) of the largest dot product; of equals in a block the least.

    Rows are dealt into blocks, and a block is one row. Tasks read a block of states and some of tokens where they
    were written, so each vector is shuffled once, however many blocks there are; a state's best of each block of
    tokens is shuffled too. Products are made in stretches of BLOCK states and TOKENS tokens.
    """
    small_batches(states.sparkSession, size=ARROW_BYTES)
    rows, columns = BLOCK, TOKENS
    s, t = (max(1, -(-df.count() // n)) for df, n in ((states, state_block), (tokens, token_block)))
    asks = _packed(states.select(F.col("vec_id").cast("long").alias("id"), "x").repartition(s), state_block)
    table = pinned(_packed(tokens.select(F.col("token").cast("long").alias("id"), "x").repartition(t), token_block), "tokens")
    pairs = asks.crossJoin(table.select(F.col("ids").alias("tokens"), F.col("vectors").alias("weights")))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, vectors, tokens, weights in batch.itertuples(index=False):
                ids, tokens = np.frombuffer(ids, np.int64), np.frombuffer(tokens, np.int64)
                x, y = np.frombuffer(vectors).reshape(len(ids), -1), np.frombuffer(weights).reshape(len(tokens), -1)
                at, logit = np.zeros(len(x), np.int64), np.zeros(len(x))
                for i in range(0, len(x), rows):
                    for j in range(0, len(y), columns):
                        score = x[i : i + rows] @ y[j : j + columns].T
                        top = score.argmax(axis=1)
                        found, own = score[np.arange(len(top)), top], slice(i, i + len(top))
                        # NaN is above all, as in Spark's order; of equals the first stays.
                        over = ~(found <= logit[own]) & ~np.isnan(logit[own]) if j else np.ones(len(top), bool)
                        at[own], logit[own] = np.where(over, top + j, at[own]), np.where(over, found, logit[own])
                yield pd.DataFrame({"vec_id": ids, "token": tokens[at], "logit": logit})

    found = pairs.mapInPandas(best, "vec_id long, token long, logit double")
    top = F.max(F.struct("logit", (-F.col("token")).alias("token"))).alias("top")
    return found.groupBy("vec_id").agg(top).select("vec_id", (-F.col("top.token")).alias("token"), F.col("top.logit").alias("logit"))
