"""Queries over the numeric kernels, on embeddings: a label is a sequence, vec_id a position."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import kernels as K
from loomtext.functions.bytes import utf8_ids
from loomtext.operators import attention, model, sampling
from loomtext.operators import tiles as T
from loomtext.operators.bpe import Codec
from loomtext.operators.order import with_position
from loomtext.plans.catalog import Catalog, table
from loomtext.session import ARROW_BYTES, fresh_path, pinned, small_batches, small_side, spread
from loomtext.sources import text as sources

HEADS, WIDTH = 4, 16
TINY = model.Config(block_size=64, vocab_size=257, n_layer=2, n_head=2, n_embd=16)
_C = Catalog()
QUERIES, ORACLES = _C.queries, _C.oracles

_V = "(SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
_W3 = [[round(((i * 7 + j * 3) % 11 - 5) / 10, 2) for j in range(8)] for i in range(3)]


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def _rounded(x):
    """A vector as a few scalars: its sum weighted by place, and its first value."""
    return F.round(K.total(F.transform(x, lambda v, i: v * (i + 1))), 5).alias("weighted"), F.round(F.get(x, F.lit(0)), 6).alias("first")


def _rounded_sql(x: str) -> str:
    return f"round(list_sum(list_transform({x}, lambda v, i: v * i)), 5) AS weighted, round({x}[1], 6) AS first"


@_C.add(f"WITH e AS (SELECT vec_id, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM {_V}), s AS (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e) SELECT vec_id, {_rounded_sql('p')} FROM s")
def softmax(spark, sf):
    return _vectors(spark, sf).select("vec_id", *_rounded(K.softmax(F.col("x"))))


@_C.add(f"SELECT label, round(avg(ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[label + 1]), 6) AS loss, count(*)::BIGINT AS n FROM {_V} WHERE label IS NOT NULL GROUP BY label")
def cross_entropy(spark, sf):
    return _vectors(spark, sf).where("label IS NOT NULL").groupBy("label").agg(F.round(F.avg(K.cross_entropy(F.col("x"), F.col("label"))), 6).alias("loss"), F.count("*").alias("n"))


_NORM = "list_transform(x, lambda v: (v - list_avg(x)) / sqrt(list_var_pop(x) + 1e-5))"


@_C.add(f"SELECT vec_id, {_rounded_sql('y')} FROM (SELECT vec_id, {_NORM} AS y FROM {_V})")
def layer_norm(spark, sf):
    return _vectors(spark, sf).select("vec_id", *_rounded(K.layer_norm(F.col("x"))))


@_C.add(f"SELECT vec_id, {_rounded_sql('y')} FROM (SELECT vec_id, list_transform(x, lambda v: 0.5 * v * (1 + tanh(sqrt(2 / pi()) * (v + 0.044715 * v * v * v)))) AS y FROM {_V})")
def gelu(spark, sf):
    return _vectors(spark, sf).select("vec_id", *_rounded(F.transform("x", K.gelu)))


@_C.add(f"SELECT d.doc_id, {_rounded_sql('x')} FROM documents d JOIN {_V} v ON v.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)")
def embedding_lookup(spark, sf):
    """Token ids (doc_id modulo the number of vectors) to their vectors in the whole table."""
    vectors = _vectors(spark, sf)
    ids = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % F.lit(max(1, vectors.count()))).alias("vec_id"))
    return ids.join(small_side(vectors), "vec_id").select("doc_id", *_rounded(F.col("x")))


def _positions(spark, sf):
    """(vec_id, label, pos): positions from 0 within a label, without a window over a label in one task."""
    placed = pinned(with_position(table(spark, sf, "embeddings").where("label IS NOT NULL").select("label", "vec_id"), ["label", "vec_id"], "at"), "positions")
    starts = placed.groupBy("label").agg(F.min("at").alias("start"))
    return placed.join(small_side(starts), "label").select("vec_id", "label", (F.col("at") - F.col("start")).alias("pos"))


@_C.add(f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM {_V} WHERE label IS NOT NULL) SELECT t.vec_id, {_rounded_sql('list_transform(list_zip(t.x, w.x), lambda z: z[1] + z[2])')} FROM p t JOIN {_V} w ON w.vec_id = t.pos")
def position_add(spark, sf):
    placed = _vectors(spark, sf).select("vec_id", "x").join(small_side(_positions(spark, sf).select("vec_id", "pos")), "vec_id")
    table_of_positions = _vectors(spark, sf).select(F.col("vec_id").alias("pos"), F.col("x").alias("p"))
    return placed.join(small_side(table_of_positions), "pos").select("vec_id", *_rounded(K.add(F.col("x"), F.col("p"))))


@_C.add(f"""WITH a AS (SELECT q.vec_id, k.vec_id AS key, list_dot_product(q.x, k.x) / sqrt(64) AS score, k.x AS v FROM {_V} q JOIN {_V} k ON q.label = k.label AND k.vec_id <= q.vec_id),
 m AS (SELECT vec_id, max(score) AS top FROM a GROUP BY vec_id), e AS (SELECT a.vec_id, exp(score - top) AS w, v FROM a JOIN m USING (vec_id))
 SELECT vec_id, count(*)::BIGINT AS keys, round(sum(w * v[1]) / sum(w), 6) AS first, round(sum(w * list_sum(v)) / sum(w), 5) AS total FROM e GROUP BY vec_id""")
def causal_attention(spark, sf):
    """Each position over itself and those before it in its sequence."""
    rows = _vectors(spark, sf).join(small_side(_positions(spark, sf)), ["vec_id", "label"])
    out = attention.causal(rows.select("label", "pos", "vec_id", "x"))
    return out.select("vec_id", "keys", F.round(F.get("mixed", F.lit(0)), 6).alias("first"), F.round(K.total(F.col("mixed")), 5).alias("total"))


@_C.add(f"SELECT vec_id, h::INT AS head, round(list_sum(x[h * {WIDTH} + 1 : h * {WIDTH} + {WIDTH}]), 6) AS total FROM {_V}, range({HEADS}) t(h)")
def split_heads(spark, sf):
    parts = F.array(*(K.head(F.col("x"), h, WIDTH) for h in range(HEADS)))
    return _vectors(spark, sf).select("vec_id", F.posexplode(parts).alias("head", "part")).select("vec_id", "head", F.round(K.total(F.col("part")), 6).alias("total"))


@_C.add(f"SELECT vec_id, {_rounded_sql('x')} FROM {_V}")
def join_heads(spark, sf):
    parts = F.array(*(F.struct(F.lit(h).alias("h"), K.head(F.col("x"), h, WIDTH).alias("part")) for h in range(HEADS)))
    split = _vectors(spark, sf).select("vec_id", F.explode(parts).alias("e")).select("vec_id", "e.h", "e.part")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("h", "part"))), lambda e: e["part"]))
    return split.groupBy("vec_id").agg(whole.alias("x")).select("vec_id", *_rounded(F.col("x")))


@_C.add(f"SELECT vec_id, rank, i, round(v, 6) AS p FROM (SELECT vec_id, i::INT AS i, x[i + 1] AS v, row_number() OVER (PARTITION BY vec_id ORDER BY x[i + 1] DESC, i)::INT AS rank FROM (SELECT vec_id, x, unnest(range(64)) AS i FROM {_V})) WHERE rank <= 5")
def topk(spark, sf):
    found = _vectors(spark, sf).select("vec_id", F.posexplode(K.top_k(F.col("x"), 5)).alias("rank", "e"))
    return found.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("e.i").alias("i"), F.round("e.p", 6).alias("p"))


_ORDER = "list_transform(list_sort(list_transform(range(64), lambda i: {'n': -x[i + 1], 'i': i})), lambda s: s.i)"


@_C.add(f"SELECT vec_id, ({_ORDER})[vec_id % 5 + 1]::INT AS token FROM {_V}")
def gather(spark, sf):
    best = K.top_k(F.col("x"), 5)
    return _vectors(spark, sf).select("vec_id", F.get(best, (F.col("vec_id") % 5).cast("int"))["i"].alias("token"))


@_C.add(f"SELECT doc_id, strlen(text)::INT + 1 AS n, (doc_id % 256)::INT AS last_id FROM documents")
def append_token(spark, sf):
    grown = table(spark, sf, "documents").select("doc_id", F.concat(utf8_ids(F.col("text")), F.array((F.col("doc_id") % 256).cast("int"))).alias("ids"))
    return grown.select("doc_id", F.size("ids").alias("n"), F.element_at("ids", -1).alias("last_id"))


@_C.add(f"SELECT label, max(vec_id) AS vec_id, round(arg_max(x[64], vec_id), 6) AS last FROM {_V} WHERE label IS NOT NULL GROUP BY label")
def last_position(spark, sf):
    return _vectors(spark, sf).where("label IS NOT NULL").groupBy("label").agg(F.max("vec_id").alias("vec_id"), F.round(F.max_by(F.element_at("x", -1), "vec_id"), 6).alias("last"))


@_C.add("SELECT doc_id, strlen(text)::INT AS n FROM documents WHERE strlen(text) <= 1024")
def sequence_guard(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("n")).where("n <= 1024")


@_C.add(f"SELECT vec_id, {', '.join(f'round(list_dot_product(x[1:8], {row}::DOUBLE[]) + 0.5, 6) AS y{i}' for i, row in enumerate(_W3))} FROM {_V}")
def affine(spark, sf):
    out = K.affine(K.head(F.col("x"), 0, 8), _W3, [0.5] * 3)
    return _vectors(spark, sf).select("vec_id", out.alias("y")).select("vec_id", *(F.round(F.get("y", F.lit(i)), 6).alias(f"y{i}") for i in range(3)))


def _affine_sql(x: str, weights, bias) -> str:
    return "[" + ", ".join(f"list_dot_product({x}, {row}::DOUBLE[]) + {c}" for row, c in zip(weights, bias)) + "]"


_RULE = lambda rows, columns, k: [[round(((i * 7 + j * 3 + k) % 11 - 5) / 10, 2) for j in range(columns)] for i in range(rows)]
_G, _B, _FC, _FC_B, _OUT, _OUT_B = _RULE(1, 8, 1)[0], _RULE(1, 8, 2)[0], _RULE(32, 8, 3), _RULE(1, 32, 4)[0], _RULE(8, 32, 5), _RULE(1, 8, 6)[0]
_NORMED = f"list_transform(range(1, 9), lambda i: (x[i] - list_avg(x)) / sqrt(list_var_pop(x) + 1e-5) * ({_G}::DOUBLE[])[i] + ({_B}::DOUBLE[])[i])"
_GELU = "list_transform(h, lambda v: 0.5 * v * (1 + tanh(sqrt(2 / pi()) * (v + 0.044715 * v * v * v))))"


@_C.add(f"""SELECT vec_id, {_rounded_sql('y')} FROM (SELECT vec_id, list_transform(range(1, 9), lambda i: x[i] + o[i]) AS y FROM (SELECT vec_id, x, {_affine_sql('g', _OUT, _OUT_B)} AS o
 FROM (SELECT vec_id, x, {_GELU} AS g FROM (SELECT vec_id, x, {_affine_sql('n', _FC, _FC_B)} AS h FROM (SELECT vec_id, x, {_NORMED} AS n FROM (SELECT vec_id, x[1:8] AS x FROM {_V}))))))""")
def residual_block(spark, sf):
    """A pre-norm residual step on eight dimensions: x plus the second affine map of GELU of the first one of the scaled
    and shifted layer norm of x. The attention half is causal_attention, both together model_forward."""
    literal = lambda values: F.array(*map(F.lit, values))
    rows = _vectors(spark, sf).select("vec_id", K.head(F.col("x"), 0, 8).alias("x"))
    normed = rows.withColumn("n", F.zip_with(F.zip_with(K.layer_norm(F.col("x")), literal(_G), lambda v, g: v * g), literal(_B), lambda v, b: v + b))
    hidden = normed.withColumn("g", F.transform(K.affine(F.col("n"), _FC, _FC_B), K.gelu))
    return hidden.select("vec_id", K.add(F.col("x"), K.affine(F.col("g"), _OUT, _OUT_B)).alias("y")).select("vec_id", *_rounded(F.col("y")))


@_C.add(f"SELECT vec_id, arg_max(w, s)::BIGINT AS token, round(max(s), 6) AS logit FROM (SELECT v.vec_id, w.vec_id AS w, list_dot_product(v.x, w.x) AS s FROM {_V} v, {_V} w) GROUP BY vec_id")
def tied_head(spark, sf):
    """Each state against every token vector, from the same table that embeds: the likeliest token and its logit."""
    states = _vectors(spark, sf).select("vec_id", "x")
    return attention.likeliest(states, states.select(F.col("vec_id").alias("token"), "x")).select("vec_id", "token", F.round("logit", 6).alias("logit"))


#: Names and shapes of the tiny model, whose stored values follow a rule: the i-th value of the k-th weight.
_SHAPES = model.shapes(TINY)


def _checkpoint(spark):
    """The tiny model's weights as a checkpoint stores them, four kinds turned and buffers beside them; written and read."""
    rows = spark.createDataFrame([(k, n, [s[1], s[0]] if n.endswith(model.TRANSPOSED) else list(s)) for k, (n, s) in enumerate(_SHAPES.items())], "k int, name string, shape array<int>")
    size = F.aggregate("shape", F.lit(1), lambda p, v: p * v)
    values = F.transform(F.sequence(F.lit(0), size - 1), lambda i: ((F.col("k") * 31 + i * 7) % 101 - 50) / F.lit(1000.0))
    buffers = spark.createDataFrame([(f"transformer.h.0{b}", [1], [0.0]) for b in model.BUFFERS], "name string, shape array<int>, values array<double>")
    path = fresh_path(spark, "checkpoint")
    rows.select("name", "shape", values.alias("values")).unionByName(buffers).write.parquet(path)
    return sources.read_weights(spark, path)


def _rows_of(spark, sf):
    """(name, row, values): all vectors as the rows of one matrix, in the order of vec_id."""
    placed = with_position(table(spark, sf, "embeddings").select("vec_id"), "vec_id", "row")
    return _vectors(spark, sf).join(small_side(pinned(placed, "places")), "vec_id").select(F.lit("x").alias("name"), "row", F.col("x").alias("values"))


_ROWS = f"(SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, label, x FROM {_V})"
_GRAM = f"SELECT i, j, sum(x[i + 1] * x[j + 1]) AS v FROM {_ROWS}, range(64) a(i), range(64) b(j) GROUP BY i, j"


@_C.add(f"""SELECT 'transformer.h.' || layer || '.mlp.c_fc.weight' AS name, '64,' || max(n) AS shape, round(sum(x[d + 1] * (d * n + k + 1)), 4) AS weighted, count(*)::BIGINT AS n
 FROM (SELECT row // 64 AS layer, row % 64 AS k, x, count(*) OVER (PARTITION BY row // 64) AS n FROM {_ROWS}), range(64) t(d) GROUP BY layer
 UNION ALL SELECT 'transformer.h.' || row // 64 || '.mlp.c_fc.bias', '64', round(sum(x[d + 1] * (d + 1)), 4), 64::BIGINT FROM {_ROWS}, range(64) t(d) WHERE row % 64 = 0 GROUP BY row""")
def checkpoint_match(spark, sf):
    """A checkpoint of a layer for each 64 vectors, stored turned, and a bias, its first vector: matched by name, turned
    back, a buffer left out. A matrix is a row's array here, so only small ones; checkpoint_tiles has any size."""
    placed = _rows_of(spark, sf).select(F.floor(F.col("row") / 64).alias("layer"), "row", "values")
    named = lambda kind: F.format_string("transformer.h.%d.mlp.c_fc." + kind, "layer").alias("name")
    whole = placed.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("row", "values"))).alias("rows"))
    values = F.col("rows.values")
    weights = whole.select(named("weight"), F.array(F.size("rows"), F.lit(64)).alias("shape"), F.flatten(values).alias("values"))
    biases = whole.select(named("bias"), F.array(F.lit(64)).alias("shape"), values[0].alias("values"))
    buffers = spark.createDataFrame([(f"transformer.h.0{b}", [1], [0.0]) for b in model.BUFFERS], "name string, shape array<int>, values array<double>")
    path = fresh_path(spark, "checkpoint")
    weights.unionByName(biases).unionByName(buffers).write.parquet(path)
    sizes = placed.groupBy("layer").agg(F.count("*").cast("int").alias("n"))
    own = sizes.select(named("weight"), F.array(F.lit(64), F.col("n")).alias("shape")).unionByName(sizes.select(named("bias"), F.array(F.lit(64)).alias("shape")))
    found = model.match_checkpoint(own, sources.read_weights(spark, path))
    weighted = K.total(F.transform("values", lambda v, i: v * (i + 1)))
    return found.select("name", F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), F.round(weighted, 4).alias("weighted"), F.size("values").cast("long").alias("n"))


@_C.add(f"SELECT i::BIGINT AS row, round(sum(v * (j + 1)), 4) AS weighted, round(max(v), 5) AS largest FROM ({_GRAM}) GROUP BY i")
def tile_product(spark, sf):
    """The matrix of all vectors, turned, times itself: tiles meet by blocks of vectors, whose partial products are summed."""
    tiles = pinned(T.from_rows(_rows_of(spark, sf)), "tiles")
    found = T.entries(T.product(T.transposed(tiles), tiles))
    return found.select("row", F.round(K.total(F.transform("values", lambda v, i: v * (i + 1))), 4).alias("weighted"), F.round(F.array_max("values"), 5).alias("largest"))


_BIG = "transformer.wte.weight", "transformer.h.0.attn.c_proj.weight"


@_C.add(f"""SELECT name, rows, columns, round(sum(v * ((r * 31 + c * 7) % 101 + 1)), 4) AS weighted, count(*)::BIGINT AS n FROM (
 SELECT '{_BIG[0]}' AS name, (SELECT count(*) FROM embeddings)::BIGINT AS rows, 64::BIGINT AS columns, row AS r, d AS c, x[d + 1] AS v FROM {_ROWS}, range(64) t(d)
 UNION ALL SELECT '{_BIG[1]}', 64, (SELECT count(*) FROM embeddings), d, row, x[d + 1] FROM {_ROWS}, range(64) t(d)) GROUP BY ALL""")
def checkpoint_tiles(spark, sf):
    """A checkpoint whose weights are all vectors, one of them stored turned, written as tiles, matched and read."""
    rows = pinned(_rows_of(spark, sf), "rows")
    n = rows.count()
    stored = [rows.withColumn("name", F.lit(name)) for name in _BIG]
    buffer = spark.range(1).select(F.lit(f"transformer.h.0{model.BUFFERS[0]}").alias("name"), F.lit(0).cast("long").alias("row"), F.array(F.lit(0.0)).alias("values"))
    path = fresh_path(spark, "checkpoint")
    T.from_rows(reduce(DataFrame.unionByName, [*stored, buffer])).write.parquet(path)
    own = spark.createDataFrame([(_BIG[0], [n, 64]), (_BIG[1], [64, n])], "name string, shape array<int>")
    found = T.entries(T.match_checkpoint(own, spark.read.schema(T.TILES).parquet(path)))
    weight = lambda v, i: v * ((F.col("row") * 31 + (F.col("j") * T.TILE + i) * 7) % 101 + 1)
    sums = found.groupBy("name").agg((F.max("row") + 1).alias("rows"), F.max(F.col("j") * T.TILE + F.size("values")).cast("long").alias("columns"), F.round(F.sum(K.total(F.transform("values", weight))), 4).alias("weighted"), F.sum(F.size("values")).alias("n"))
    return sums.select("name", "rows", "columns", "weighted", "n")


_HIDDEN = 256
_BY_RULE = lambda k, i, j: f"((({i}) * 7 + ({j}) * 3 + {k}) % 11 - 5) / 40.0"


def _rule(spark, k, name, rows, columns):
    values = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: ((F.col("id") * 7 + j * 3 + k) % 11 - 5) / F.lit(40.0))
    return spark.range(rows).select(F.lit(f"transformer.h.0.{name}").alias("name"), F.col("id").alias("row"), values.alias("values"))


@_C.add(f"""WITH n AS (SELECT row, x, list_transform(range(0, 64), lambda i: (x[i + 1] - list_avg(x)) / sqrt(list_var_pop(x) + 1e-5) * {_BY_RULE(1, 0, 'i')} + {_BY_RULE(2, 0, 'i')}) AS n FROM {_ROWS}),
 fc AS (SELECT list(list_transform(range(0, 64), lambda j: {_BY_RULE(3, 'i', 'j')}) ORDER BY i) AS w FROM range(0, {_HIDDEN}) t(i)),
 proj AS (SELECT list(list_transform(range(0, {_HIDDEN}), lambda j: {_BY_RULE(5, 'i', 'j')}) ORDER BY i) AS w FROM range(0, 64) t(i)),
 h AS (SELECT row, x, list_transform(range(0, {_HIDDEN}), lambda i: list_dot_product(n, w[i + 1]) + {_BY_RULE(4, 0, 'i')}) AS h FROM n, fc),
 g AS (SELECT row, x, list_transform(h, lambda v: 0.5 * v * (1 + tanh(sqrt(2 / pi()) * (v + 0.044715 * v * v * v)))) AS g FROM h)
 SELECT row, round(list_sum(list_transform(range(0, 64), lambda i: (x[i + 1] + list_dot_product(g, w[i + 1]) + {_BY_RULE(6, 0, 'i')}) * (i + 1))), 4) AS weighted FROM g, proj""")
def mlp_tiles(spark, sf):
    """The MLP half of a layer on all vectors at their full width, as products of tiles."""
    shapes = [(1, "ln_2.weight", 1, 64), (2, "ln_2.bias", 1, 64), (3, "mlp.c_fc.weight", _HIDDEN, 64), (4, "mlp.c_fc.bias", 1, _HIDDEN), (5, "mlp.c_proj.weight", 64, _HIDDEN), (6, "mlp.c_proj.bias", 1, 64)]
    weights = pinned(T.from_rows(reduce(DataFrame.unionByName, [_rule(spark, *s) for s in shapes])), "weights")
    out = T.entries(T.mlp(pinned(T.from_rows(_rows_of(spark, sf)), "states"), weights))
    return out.select("row", F.round(K.total(F.transform("values", lambda v, i: v * (i + 1))), 4).alias("weighted"))


@_C.add(f"""WITH l AS (SELECT s.row, s.label, t.row AS token, list_dot_product(s.x, t.x) AS z FROM {_ROWS} s, {_ROWS} t), m AS (SELECT row, max(z) AS top FROM l GROUP BY row),
 e AS (SELECT row, label, any_value(top) + ln(sum(exp(z - top))) - max(z) FILTER (token = (row + 1) % (SELECT count(*) FROM embeddings)) AS loss FROM l JOIN m USING (row) GROUP BY row, label)
 SELECT label, round(avg(loss), 6) AS loss, count(*)::BIGINT AS n FROM e GROUP BY label""")
def vocabulary_loss(spark, sf):
    """Each vector as a state whose target is the next one, over all vectors as tokens, without a row of logits."""
    placed = pinned(with_position(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", "row"), "places")
    n = max(1, placed.count())
    states = _vectors(spark, sf).select("vec_id", "x").join(small_side(placed), "vec_id")
    losses = T.vocabulary_loss(states.select("row", "x", ((F.col("row") + 1) % n).alias("target")), states.select(F.col("row").alias("token"), "x"))
    return losses.join(small_side(placed), "row").groupBy("label").agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("*").alias("n"))


def tiny_weights(spark):
    return model.load_weights(model.match_checkpoint(model.own_names(spark, TINY), _checkpoint(spark)))


_U = f"('0x' || substr(md5('{42}:' || name || ':' || {{k}} || ':' || row || ':' || j), 1, 13))::BIGINT / pow(16, 13)"


@_C.add(f"""WITH d AS (SELECT name, row, scale * sqrt(-2 * ln(1 - {_U.format(k=0)})) * cos(2 * pi() * {_U.format(k=1)}) AS v
 FROM (VALUES ('wte', 0.02::DOUBLE), ('c_proj', 0.02 / sqrt(24))) n(name, scale), (SELECT vec_id AS row FROM embeddings), range(16) c(j))
 SELECT name, row, round(sum(v), 6) AS total, round(sqrt(sum(v * v) / 16), 6) AS spread FROM d GROUP BY name, row""")
def normal_init(spark, sf):
    """First weights of width 16 for every vector's token, as an embedding and as a residual projection."""
    tokens = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row"))
    rows = sampling.normal_weights(tokens, "wte", 16).unionByName(sampling.normal_weights(tokens, "c_proj", 16, layers=12))
    square = F.transform("values", lambda v: v * v)
    return rows.select("name", "row", F.round(K.total(F.col("values")), 6).alias("total"), F.round(F.sqrt(K.total(square) / F.size("values")), 6).alias("spread"))


def score_windows(docs, weights):
    """(doc_id, tokens, loss) of (doc_id, ids): windows are a block and the token after it, which the next one starts with."""
    targets = F.sum("targets")
    scored = model.losses(docs, TINY, weights).groupBy("doc_id")
    return scored.agg((targets + F.max(F.least("n", F.lit(1)))).alias("tokens"), F.round(F.sum("loss") / F.nullif(targets, F.lit(0)), 6).alias("loss"))


@_C.add()
def model_forward(spark, sf):
    """The tiny model over windows of every document's bytes; each token after a document's first is a target once."""
    docs = spread(table(small_batches(spark, size=ARROW_BYTES), sf, "documents").select("doc_id", "text"))
    ids = F.coalesce("text", F.lit("")).cast("binary")
    return score_windows(docs.select("doc_id", ids.alias("ids")), tiny_weights(spark))


#: The tiny model with room for a whole benchmark text and what is grown from it.
LONG = dataclasses.replace(TINY, block_size=4_096)
GROWN = 6


@_C.add()
def generate(spark, sf):
    """Two continuations of every benchmark text, GROWN tokens each."""
    prompts = sampling.repeat(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), Codec([]).encode("text").alias("ids")), 2)
    grown = model.generate(spread(prompts.where("ids IS NOT NULL")), LONG, model.random_weights(LONG), length=F.size("ids") + GROWN)
    return grown.select("id", "seq", F.size("ids").alias("n"), F.array_join(F.slice("ids", -GROWN, GROWN).cast("array<string>"), ",").alias("last"))
