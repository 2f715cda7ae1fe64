"""Tiles, products and the streaming loss against whole matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import tiles as T


def rows(spark, x, name="x"):
    return spark.createDataFrame([(name, i, [float(v) for v in r]) for i, r in enumerate(np.atleast_2d(x))], "name string, row long, values array<double>")


def whole(tiles, tile):
    found = tiles.collect()
    out = np.full((max(r["i"] * tile + r["rows"] for r in found), max(r["j"] * tile + r["columns"] for r in found)), np.nan)
    for r in found:
        out[r["i"] * tile : r["i"] * tile + r["rows"], r["j"] * tile : r["j"] * tile + r["columns"]] = T._tile(r)
    assert len(found) == len({(r["i"], r["j"]) for r in found})
    return out


@pytest.mark.parametrize("n, k, m", [(7, 5, 4), (1, 9, 1), (6, 3, 10)])
def test_products_of_any_shape(spark, n, k, m, monkeypatch):
    draw = np.random.default_rng(n)
    x, y = draw.normal(size=(n, k)), draw.normal(size=(k, m))
    a, b = T.from_rows(rows(spark, x).repartition(3), 3), T.from_rows(rows(spark, y), 3)
    np.testing.assert_array_equal(whole(a, 3), x)
    np.testing.assert_array_equal(whole(T.transposed(a), 3), x.T)
    for summed in (T.SUMMED, 10):  # sent on at once, too
        monkeypatch.setattr(T, "SUMMED", summed)
        np.testing.assert_allclose(whole(T.product(a, b), 3), x @ y, atol=1e-12)
    monkeypatch.setattr(T, "small_side", lambda df: df)  # both sides shuffled
    np.testing.assert_allclose(whole(T.product(a, b), 3), x @ y, atol=1e-12)
    with pytest.raises(Exception, match="columns meet"):
        T.product(a, T.from_rows(rows(spark, draw.normal(size=(k + 1, m))), 3)).collect()
    assert T.product(a.limit(0), b).count() == 0


def test_rows_missing_or_twice(spark):
    made = rows(spark, np.ones((5, 2)))
    for bad in (made.unionByName(made.limit(1)), made.where("row <> 1")):
        with pytest.raises(Exception, match="missing or there twice"):
            T.from_rows(bad, 3).collect()


def test_checkpoint_of_tiles(spark):
    draw = np.random.default_rng(2)
    turned, plain, bias = draw.normal(size=(5, 8)), draw.normal(size=(7, 4)), draw.normal(size=6)
    names = ["transformer.h.0.attn.c_attn.weight", "transformer.wte.weight", "transformer.h.0.attn.c_attn.bias", "transformer.h.0.attn.bias"]
    stored = T.from_rows(rows(spark, turned, names[0]).unionByName(rows(spark, plain, names[1])).unionByName(rows(spark, bias, names[2])).unionByName(rows(spark, [1.0], names[3])), 3)
    own = lambda *shapes: spark.createDataFrame(list(zip(names, shapes)), "name string, shape array<int>")
    found = T.match_checkpoint(own([8, 5], [7, 4], [6]), stored, 3)
    for name, x in zip(names, (turned.T, plain, bias[None])):
        np.testing.assert_array_equal(whole(found.where(F.col("name") == name), 3), x)
    for bad, tiles in ((own([5, 8], [7, 4], [6]), stored), (own([8, 5], [7, 4]), stored), (own([8, 5], [7, 4], [6]), stored.where("NOT (name LIKE '%wte%' AND i = 1 AND j = 0)")), (own([8, 5], [7, 4], [6]), stored.unionByName(stored.where("i = 1 AND j = 1")))):
        with pytest.raises(ValueError, match="no match for transformer"):
            T.match_checkpoint(bad, tiles, 3)


def test_mlp_at_width_768(spark):
    draw = np.random.default_rng(3)
    x, fc, proj, g, b1, b2, b3 = draw.normal(size=(40, 768)), draw.normal(size=(3072, 768)) * 0.02, draw.normal(size=(768, 3072)) * 0.02, *(draw.normal(size=n) for n in (768, 768, 3072, 768))
    at = "transformer.h.0."
    weights = [T.from_rows(rows(spark, w, at + name)) for w, name in ((g, "ln_2.weight"), (b1, "ln_2.bias"), (fc, "mlp.c_fc.weight"), (b2, "mlp.c_fc.bias"), (proj, "mlp.c_proj.weight"), (b3, "mlp.c_proj.bias"))]
    made = weights[0]
    for w in weights[1:]:
        made = made.unionByName(w)
    normed = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5) * g + b1
    wanted = x + T.gelu(normed @ fc.T + b2) @ proj.T + b3
    np.testing.assert_allclose(whole(T.mlp(T.from_rows(rows(spark, x)), made), T.TILE), wanted, atol=1e-8)
    assert made.agg(F.max(F.length("values"))).first()[0] == 8 * T.TILE**2  # no row holds more of a matrix


def test_streaming_loss(spark):
    draw = np.random.default_rng(4)
    x, y = draw.normal(size=(60, 6)) * 20, draw.normal(size=(90, 6)) * 20  # logits that overflow unless scaled
    target = [None if i == 5 else 1000 if i == 6 else int(draw.integers(90)) for i in range(60)]
    states = spark.createDataFrame([(i, v.tolist(), t) for i, (v, t) in enumerate(zip(x, target))], "row long, x array<double>, target long")
    tokens = spark.createDataFrame(list(enumerate(y.tolist())), "token long, x array<double>")
    logits = x @ y.T
    top = logits.max(axis=1)
    lse = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
    for options in ({}, {"state_block": 7, "token_block": 11, "at_once": 4}):
        found = {r["row"]: r["loss"] for r in T.vocabulary_loss(states, tokens, **options).collect()}
        assert len(found) == 60 and found[5] is None and found[6] is None
        assert all(found[i] == pytest.approx(lse[i] - logits[i, t], abs=1e-9) for i, t in enumerate(target) if i not in (5, 6))
    assert T.vocabulary_loss(states.limit(0), tokens).count() == 0
