"""Table functions for SQL: statistics and packing over TABLE arguments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _field(table: AnalyzeArgument, name: str, kind: type[T.DataType] | None = None) -> T.DataType:
    """The type of a column of a TABLE argument; a missing one, or one of another kind, is an error of analysis."""
    if not table.isTable:
        raise ValueError("the first argument must be TABLE(...)")
    found = {f.name: f.dataType for f in table.dataType.fields}
    if name not in found or (kind is not None and not isinstance(found[name], kind)):
        raise ValueError(f"the table needs a column {name}" + (f" of {kind.typeName()}" if kind else ""))
    return found[name]


class PairStats:
    """pair_stats(TABLE(SELECT key, text ...)): (key, a, b, cnt) of adjacent UTF-8 bytes, summed over what a task reads.

    Sum cnt by key, a and b over the result; with PARTITION BY key that is done already. A task holds 65,536 sums a key.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        key = _field(table, "key")
        _field(table, "text", T.StringType)
        return AnalyzeResult(T.StructType().add("key", key).add("a", T.IntegerType()).add("b", T.IntegerType()).add("cnt", T.LongType()))

    def __init__(self):
        self.cells: dict = {}

    def eval(self, row: Row) -> None:
        ids = np.frombuffer((row["text"] or "").encode("utf-8", "replace"), np.uint8).astype(np.int64)
        if len(ids) > 1:
            cells = self.cells.setdefault(row["key"], np.zeros(65_536, np.int64))
            cell, n = np.unique(ids[:-1] * 256 + ids[1:], return_counts=True)
            cells[cell] += n

    def terminate(self) -> Iterator[tuple]:
        for key, cells in self.cells.items():
            for cell in np.flatnonzero(cells).tolist():
                yield key, cell >> 8, cell & 255, int(cells[cell])


class PackRows:
    """pack_rows(TABLE(SELECT key, ids ...) PARTITION BY (key) [ORDER BY ...], t): (key, row, x), the ids of a partition's rows
    laid end to end in rows of t; what fills none is dropped. A task holds less than one row besides what it reads."""

    @staticmethod
    def analyze(table: AnalyzeArgument, t: AnalyzeArgument) -> AnalyzeResult:
        key = _field(table, "key")
        ids = _field(table, "ids", T.ArrayType)
        if not t.isConstantExpression or not isinstance(t.value, int) or t.value < 1:
            raise ValueError("the length of a row must be a positive constant")
        return AnalyzeResult(T.StructType().add("key", key).add("row", T.LongType()).add("x", ids))

    def __init__(self):
        self.rest: list = []
        self.row = 0

    def eval(self, row: Row, t: int) -> Iterator[tuple]:
        ids = self.rest + list(row["ids"] or ())
        for i in range(0, len(ids) - t + 1, t):
            yield row["key"], self.row, ids[i : i + t]
            self.row += 1
        self.rest = ids[len(ids) - len(ids) % t :]


def register(spark: SparkSession) -> None:
    """pair_stats and pack_rows as table functions of the session."""
    spark.udtf.register("pair_stats", udtf(PairStats))
    spark.udtf.register("pack_rows", udtf(PackRows))
