"""Streams with state: documents packed into rows as they arrive, and pair counts that follow them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtext.operators.bpe import Codec
from loomtext.operators.pair_store import PairStore

#: About the tokens of a block that a task hands on: an Arrow batch holds a session's number of them at once.
BLOCK = 1 << 12


def pack_stream(docs: DataFrame, keys: list[str], t: int, codec: Codec | None = None) -> DataFrame:
    """(keys, row, x, y) of (keys, doc_id, ids), a token stream for each key; y is x shifted by one token. With a codec
    docs has `text` in place of ids, and texts are shuffled and encoded where they are packed.

    A stream's documents follow each other by micro-batch and within it by doc_id, null first; of one doc_id by their
    ids or texts. A row comes out as soon as its last target is there. The state of a key is its next row's number and
    the at most t tokens that begin it, so a stream that was stopped goes on where it was. A task holds one micro-batch
    of a key: bound what a trigger reads, and add a column to the keys that deals a large one over several streams.
    """
    encoded, given = (None, "ids") if codec is None else (codec.encoded, "text")

    def grow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row, rest = state.get if state.exists else (0, b"")
        arrived = []
        for batch in batches:
            if encoded is None:
                texts = [np.asarray(() if ids is None else ids, "<i4") for ids in batch[given]]
                order = [ids.astype(">i4").tobytes() for ids in texts]
            else:
                order = [text or "" for text in batch[given]]
                texts = encoded(order)
            arrived += zip(batch["known"], batch["doc_id"], order, texts)
        arrived.sort(key=lambda d: d[:3])  # no filter on ids before: it would be pushed down and compute them twice
        ids = np.concatenate([np.frombuffer(rest, "<i4"), *(d[3] for d in arrived)])
        n = max(0, len(ids) - 1) // t
        state.update((row + n, ids[n * t :].astype("<i4").tobytes()))
        size = max(1, BLOCK // t)
        starts = range(0, n, size)
        found = pd.DataFrame({"first": [row + i for i in starts], "ids": pd.Series([ids[i * t : min(n, i + size) * t + 1] for i in starts], dtype=object)})
        for name, value in zip(reversed(keys), reversed(key)):
            found.insert(0, name, pd.Series([value] * len(found), dtype=object))
        yield found

    out = T.StructType([docs.schema[k] for k in keys]).add("first", T.LongType()).add("ids", T.ArrayType(T.IntegerType()))
    rows = docs.select(*keys, F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col(given).cast("array<int>" if codec is None else "string").alias(given))
    blocks = rows.groupBy(*keys).applyInPandasWithState(grow, out, "row long, rest binary", "append", GroupStateTimeout.NoTimeout)
    # A block is some rows and the token after them; the rows are cut here, not in Python.
    # Its rows' numbers are exploded, not the rows: what is in a lambda is interpreted, a slice outside is compiled.
    numbered = blocks.select(*keys, "first", "ids", F.explode(F.sequence(F.lit(0), F.expr(f"int((size(ids) - 1) div {t}) - 1"))).alias("i"))
    at = lambda shift: F.slice("ids", F.col("i") * t + 1 + shift, t)
    return numbered.select(*keys, (F.col("first") + F.col("i")).alias("row"), at(0).alias("x"), at(1).alias("y"))


def write_rows(packed: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows that all files there fill, then stops; run again for what has come since."""
    return packed.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_pairs(changed: DataFrame, store: PairStore, checkpoint: str) -> StreamingQuery:
    """Applies a stream of (text, sign) to the store, a micro-batch as the change of its number, then stops."""

    def apply(rows: DataFrame, number: int) -> None:
        store.apply(number, rows)

    return changed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
