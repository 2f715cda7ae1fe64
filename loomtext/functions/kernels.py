"""Numeric kernels of a transformer as array columns of doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def bind(value: Column, use) -> Column:
    """use(value), with value computed once: an expression inside a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(x: Column) -> Column:
    exponents = bind(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return bind(exponents, lambda e: bind(total(e), lambda s: F.transform(e, lambda v: v / s)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax(logits)[target], target from 0."""
    return bind(F.array_max(logits), lambda top: top + F.log(total(F.transform(logits, lambda v: F.exp(v - top)))) - F.get(logits, target))


def layer_norm(x: Column, epsilon: float = 1e-5) -> Column:
    scaled = lambda m, q: F.transform(x, lambda v: (v - m) / F.sqrt(q + epsilon))
    spread = lambda m: total(F.transform(x, lambda v: (v - m) * (v - m))) / F.size(x)
    return bind(total(x) / F.size(x), lambda m: bind(spread(m), lambda q: scaled(m, q)))


def gelu(v: Column) -> Column:
    """The tanh form."""
    return 0.5 * v * (1 + F.tanh(math.sqrt(2 / math.pi) * (v + 0.044715 * v * v * v)))


def affine(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """weights has a row for each output."""
    literal = lambda row: F.array(*map(F.lit, row))
    return F.array(*(dot(x, literal(row)) + b for row, b in zip(weights, bias)))


def head(x: Column, h: int, width: int) -> Column:
    return F.slice(x, h * width + 1, width)


def top_k(x: Column, k: int) -> Column:
    """The k largest as structs (p, i), largest first; of equal ones the first."""
    pairs = F.transform(x, lambda v, i: F.struct((-v).alias("n"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct((-s["n"]).alias("p"), s["i"].alias("i")))


def draw(weights: Column, u: Column) -> Column:
    """Index from 0 of the first weight at which the running sum reaches u times the total."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("below"))
    step = lambda goal: lambda s, v: F.struct((s["sum"] + v).alias("sum"), (s["below"] + (s["sum"] + v < goal).cast("int")).alias("below"))
    return bind(u * total(weights), lambda goal: F.aggregate(weights, start, step(goal), lambda s: s["below"]))
