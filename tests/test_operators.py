"""Hand-worked cases and properties."""

import base64
import hashlib
import math
import random
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tests.conftest import SF

from loomtext import session
from loomtext.functions import bytes as B
from loomtext.operators import attention, bpe, model, order, packing, sampling
from loomtext.session import matched, small_side
from loomtext.sources import sinks
from loomtext.sources import text as sources
from loomtext.streaming import encode

TEXTS = ["", " ", "a", "aaa", "aaaa", "a\x00b", "x\ny", "😀", "हिन्दी", "ಕನ್ನಡ", None]


def _docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bytes_and_round_trip(spark):
    merges = [(97, 97, 256), (256, 97, 257)]
    s = B.byte_string(F.col("text"))
    rows = _docs(spark).select("text", B.utf8_ids(F.col("text")).alias("ids"), B.decode_string(B.encode_string(s, merges), merges).alias("back")).collect()
    for r in rows:
        assert r["back"] == r["text"]
        assert r["ids"] == (None if r["text"] is None else list(r["text"].encode()))


def test_merge_is_left_to_right(spark):
    rows = _docs(spark, ["aaa", "aaaaa"]).select(B.ids_of(B.merge_pair(B.byte_string(F.col("text")), 97, 97, 256)).alias("ids")).collect()
    assert [r["ids"] for r in rows] == [[256, 97], [256, 256, 97]]


def test_pairs_overlap_and_stay_in_documents(spark):
    docs = _docs(spark, ["aaa", "a", "", None, "ba"])
    assert sorted(tuple(r) for r in bpe.pair_counts(docs).collect()) == [(97, 97, 2), (98, 97, 1)]
    assert sorted(tuple(r) for r in bpe.pair_counts(docs, by_document=True).collect()) == [(0, 97, 97, 2), (4, 98, 97, 1)]
    assert bpe.pair_counts(docs.limit(0)).count() == 0


def merged(ids, a, b, new):
    out, i = [], 0
    while i < len(ids):
        hit = ids[i : i + 2] == [a, b]
        out.append(new if hit else ids[i])
        i += 2 if hit else 1
    return out


def brute_training(texts, n):
    """One merge after the other, each after a full count; a dict keeps the order of first occurrences."""
    rows, found = [list(t.encode()) for t in texts], []
    while len(found) < n:
        counts = {}
        for ids in rows:
            for pair in zip(ids, ids[1:]):
                counts[pair] = counts.get(pair, 0) + 1
        if not counts:
            break
        a, b = max(counts, key=counts.get)
        found.append((a, b, 256 + len(found)))
        rows = [merged(ids, *found[-1]) for ids in rows]
    return found


def brute_encoding(text, merges):
    ids, rank = list(text.encode()), {(a, b): i for i, (a, b, _) in enumerate(merges)}
    while known := [rank[p] for p in zip(ids, ids[1:]) if p in rank]:
        ids = merged(ids, *merges[min(known)])
    return ids


@pytest.mark.parametrize("hot, run_ids", [(1, 1 << 20), (3, 1 << 20), (64, 40), (1 << 16, 1 << 20)])
def test_training_is_one_merge_after_the_other(spark, hot, run_ids):
    """Whatever the number of hot pairs and the bound on runs, which only decide how many rounds there are."""
    draw = random.Random(hot)
    texts = ["".join(draw.choice("aab c") for _ in range(draw.randrange(50))) for _ in range(40)] + ["aaaaaaa", "", "é" * 9]
    merges = {1: 5, 3: 12}.get(hot, 40)
    assert bpe.train_stream(_docs(spark, texts).repartition(3), merges, hot=hot, run_ids=run_ids) == brute_training(texts, merges)


def test_training_within_pieces(spark):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcd") for _ in range(draw.randrange(1, 7))) for _ in range(30)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(12))) for _ in range(50)]
    pieces = [p for t in texts for p in regex.findall(bpe.GPT2_SPLIT, t)]
    assert bpe.train_chunks(_docs(spark, texts), 60, hot=7) == brute_training(pieces, 60)
    rows = bpe.vocabulary(spark, [(97, 98, 256)], "<|end|>").orderBy("id").collect()
    assert [bytes(r["bytes"]) for r in rows[-2:]] == [b"ab", b"<|end|>"] and rows[-1]["id"] == 257


def test_codec(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("abc é") for _ in range(draw.randrange(60))) for _ in range(80)] + ["aaaaa", "", None, "😀"]
    merges = brute_training([t for t in texts if t], 90)
    codec = bpe.Codec(merges)
    codec.register(spark)
    _docs(spark, texts).createOrReplaceTempView("texts")
    for r in spark.sql("SELECT *, bpe_decode(ids) AS back, bpe_decode_bytes(ids) AS raw FROM (SELECT text, bpe_encode(text) AS ids, bpe_encode_pieces(split(text, '(?= )')) AS apart FROM texts)").collect():
        assert r["ids"] == (None if r["text"] is None else brute_encoding(r["text"], merges))
        assert r["back"] == r["text"] and (r["raw"] is None or bytes(r["raw"]).decode() == r["text"])
        if r["text"]:
            assert r["apart"] == [i for p in regex.split("(?= )", r["text"]) if p for i in brute_encoding(p, merges)]
    for ids in ([999], [-1], [97, None]):
        with pytest.raises(Exception, match="unknown token id"):
            spark.createDataFrame([(ids,)], "ids array<int>").select(codec.decode("ids")).collect()
    row = spark.createDataFrame([([0x61, 0xE0, 0xA4, 0xFF, 0x62],)], "ids array<int>").select(codec.decode("ids")).first()
    assert row[0] == "a\ufffd\ufffdb"
    with pytest.raises(ValueError):
        bpe.Codec([(97, 97, 256 + i) for i in range(bpe.MAX_MERGES + 1)])
    with pytest.raises(ValueError):
        B.encode_string(F.col("text"), merges)


def test_byte_pairs_in_sql(spark):
    bpe.register_pairs(spark)
    _docs(spark, ["aab", "", None]).createOrReplaceTempView("texts")
    rows = spark.sql("SELECT doc_id, byte_pairs(text) AS p FROM texts ORDER BY doc_id").collect()
    assert [None if r["p"] is None else [tuple(x) for x in r["p"]] for r in rows] == [[(97, 97, 1), (97, 98, 1)], [], None]


def test_invalid_bytes_become_replacements(spark):
    row = spark.range(1).select(B.decode_string(B.id_string(F.array(*map(F.lit, [0x61, 0xE0, 0xA4, 0xFF, 0x62]))), []).alias("t")).first()
    assert row["t"] == "a��b"
    with pytest.raises(Exception, match="above 255"):
        spark.range(1).select(B.decode_string(B.id_string(F.array(F.lit(300))), [])).collect()


def test_training_stops_without_pairs(spark):
    assert bpe.train_stream(_docs(spark, ["ab", None, ""]), 9) == [(97, 98, 256)]
    assert bpe.train_chunks(_docs(spark, ["ab ab"]), 1) == [(97, 98, 256)]
    assert bpe.train_stream(_docs(spark, []), 5) == [] == bpe.train_chunks(_docs(spark, []), 5)


def test_split_patterns(spark):
    """Against another engine's matches, with what lies between them as pieces of its own."""
    texts = ["Let's test pre-tokenization!", "LET'S abc1 don''t \u00a0x", "हिन्दी वाक्य। और, \"यह\"!", "ಕನ್ನಡ ಹ್ಯಾಮಿಲ್ಟನ್ (ಜುಲೈ 5,1948).", "a  b\n\n c\t", "", "__x_1 ऽ़ 7"]
    gap = lambda start, end, t: [t[start:end]] if end > start else []
    for pattern in (bpe.GPT2_SPLIT, bpe.INDIC_SPLIT):
        for r in _docs(spark, texts).select("text", bpe.pre_tokens(F.col("text"), pattern).alias("p")).collect():
            want, at = [], 0
            for m in regex.finditer(pattern if pattern == bpe.GPT2_SPLIT else f"(?i){bpe.INDIC_WORDS}", r["text"]):
                want += gap(at, m.start(), r["text"]) + [m.group()]
                at = m.end()
            assert r["p"] == want + gap(at, len(r["text"]), r["text"])
    assert "हिन्दी" in _docs(spark, ["हिन्दी"]).select(bpe.pre_tokens(F.col("text"), bpe.INDIC_SPLIT)).first()[0]


@pytest.mark.parametrize("n", [0, 5, 12, 13, 24, 25, 40])
def test_packing(spark, n):
    ids = list(range(n))
    cuts = [0, n // 3, n // 3, n]
    docs = spark.createDataFrame([(i, ids[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))], "doc_id long, ids array<int>")
    packed = packing.pack(order.with_offset(docs, "doc_id", F.size("ids").cast("long")), 3, 4).orderBy("batch", "row").collect()
    assert len(packed) == packing.batches_per_epoch(n, 3, 4) * 3
    for k, r in enumerate(packed):
        assert r["x"] == ids[4 * k : 4 * k + 4] and r["y"] == ids[4 * k + 1 : 4 * k + 5]


def test_batches_by_step(spark, tmp_path):
    """Any step, the wrap and a resumed reader included; a step's filter leaves its span's folder."""
    ids = list(range(1, 200))
    docs = spark.createDataFrame([(0, ids[:3]), (3, ids[3:150]), (150, ids[150:])], "offset long, ids array<int>")
    b, t = 2, 4
    n = packing.batches_per_epoch(len(ids), b, t)
    store = packing.BatchStore.write(packing.pack(docs, b, t), str(tmp_path / "store"), n, b, t, span_tokens=32)
    wanted = lambda step: [(r, ids[(g := (step % n) * b * t + r * t) : g + t], ids[g + 1 : g + 1 + t]) for r in range(b)]
    for step in (0, n - 1, n, 7 * n + 5):
        assert sorted(tuple(r) for r in store.at(step).collect()) == wanted(step)
    for first, last in ((0, 2 * n + 3), (n - 2, n + 2), (5, 6), (3, 3), (n + 1, 2 * n), (2 * n - 1, 4 * n)):
        found = sorted(tuple(r) for r in store.between(first, last).collect())
        assert found == [(s, *row) for s in range(first, last) for row in wanted(s)]
    stopped = max(r["step"] for r in store.after(-1, 5).collect())
    again = packing.BatchStore(spark, str(tmp_path / "store"))
    assert {r["step"] for r in again.after(stopped, n).collect()} == set(range(5, 5 + n))
    plan = store.at(9)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(span" in plan and f"= {9 // 4}" in plan and "PushedFilters: [IsNotNull(batch), EqualTo(batch,9)]" in plan
    assert {p.name for p in (tmp_path / "store" / "rows").glob("span=*")} == {f"span={k}" for k in range(-(-n // 4))}
    empty = packing.BatchStore.write(packing.pack(docs.limit(0), b, t), str(tmp_path / "none"), 0, b, t)
    assert empty.at(3).count() == empty.between(0, 0).count() == 0


def test_strip_is_linear(spark):
    text = "\u2003\x1f x" + " " * 1_000_000 + "y\x85\n"
    rows = spark.createDataFrame([(t,) for t in (text, "", " \t", None, "a b", "\u3000a\x00\xa0")], "t string")
    began = time.perf_counter()
    found = [r["s"] for r in rows.select(sources.strip(F.col("t")).alias("s")).collect()]
    assert time.perf_counter() - began < 5
    assert found == [text.strip(), "", "", None, "a b", "a\x00"]


def test_decode_join_keeps_documents_without_tokens(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "doc_id long, text string")
    tokens = docs.select("doc_id", F.posexplode(B.utf8_ids(F.col("text"))).alias("pos", "id"))
    found = bpe.decode_join(tokens, bpe.vocabulary(spark, []), docs.select("doc_id", F.col("text").isNotNull().alias("encoded"))).collect()
    assert {r["doc_id"]: r["bytes"] if r["bytes"] is None else bytes(r["bytes"]) for r in found} == {1: b"ab", 2: b"", 3: None}


def test_sample_orders_few_rows(spark):
    """The rows of a plain sort, whatever the groups; of a large group only those under its cut are ordered."""
    rows = [(i, "ab"[i % 2]) for i in range(40_000)] + [(i, None) for i in range(7)] + [(77, "one id")] * 5_000
    docs = spark.createDataFrame(rows, "doc_id long, lang string").repartition(40)
    found = sampling.sample_per_group(docs, 50, seed=3)
    got = defaultdict(list)
    for r in found.orderBy("sample_rank").collect():
        got[r["lang"]].append(r["doc_id"])
    key = lambda i: (hashlib.md5(f"3:{i}".encode()).hexdigest(), i)
    for lang in ("a", "b", None, "one id"):
        assert got[lang] == sorted((i for i, g in rows if g == lang), key=key)[:50]
    ordered = [f for f in (p.parent for p in Path(session.shared_dir(spark).removeprefix("file:")).glob("near-*/_SUCCESS"))]
    newest = spark.read.parquet(f"file://{max(ordered, key=lambda f: f.stat().st_mtime)}")
    assert newest.where("lang IN ('a', 'b')").count() < 2 * 250


def test_positions_do_not_depend_on_partitions(spark):
    rows = spark.range(0, 5000, 3)
    for parts in (1, 7):
        found = order.with_position(rows.repartition(parts), "id").collect()
        assert all(r["position"] * 3 == r["id"] for r in found) and len(found) == rows.count()


def test_unknown_id_raises(spark):
    tokens = spark.createDataFrame([(1, 0, 999)], "doc_id long, pos int, id int")
    with pytest.raises(Exception, match="unknown token id 999"):
        bpe.decode_join(tokens, bpe.vocabulary(spark, []), spark.createDataFrame([(1, True)], "doc_id long, encoded boolean")).collect()


def test_lookup_decodes_every_document(spark):
    merges = [(97, 97, 256), (256, 97, 257)]
    ids = [None if i == 4 else i // 2 for i in range(len(TEXTS))]  # null and repeated ids
    docs = spark.createDataFrame(list(zip(ids, TEXTS)), "doc_id long, text string")
    encoded = docs.withColumn("ids", B.ids_of(B.encode_string(B.byte_string(F.col("text")), merges)))
    found = bpe.decode_lookup(encoded, F.col("ids"), bpe.vocabulary(spark, merges)).collect()
    plain = lambda rows: sorted(map(repr, rows))
    assert plain((r["doc_id"], None if r["bytes"] is None else bytes(r["bytes"])) for r in found) == plain((i, None if t is None else t.encode()) for i, t in zip(ids, TEXTS))
    with pytest.raises(Exception, match="unknown token id 999"):
        bpe.decode_lookup(spark.createDataFrame([(1, [999])], "doc_id long, ids array<int>"), F.col("ids"), bpe.vocabulary(spark, [])).collect()


def test_every_document_is_decoded(spark):
    from loomtext.plans import registry

    texts = spark.read.parquet(f"{SF}/documents.parquet").where("text <> ''").count()
    for name in ("decode_all_by_lookup", "decode_by_join"):
        assert registry.QUERIES[name](spark, SF).count() == texts


def test_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sources.read_text(spark, str(tmp_path / "none.txt")).collect()
    (tmp_path / "en.txt").write_text(" \thé\n ", "utf-8")
    (tmp_path / "hi.txt").write_text("\n", "utf-8")
    assert [tuple(r) for r in sources.read_corpora(spark, {"en": str(tmp_path / "en.txt")}).collect()] == [(0, "en", "hé")]
    with pytest.raises(Exception, match="the hi corpus is empty"):
        sources.read_corpora(spark, {"hi": str(tmp_path / "hi.txt")}).collect()
    merges = [(116, 104, 256), (256, 101, 257)]
    sinks.save_tokenizer(bpe.merge_table(spark, merges), bpe.vocabulary(spark, merges), str(tmp_path / "tok"))
    assert spark.read.parquet(str(tmp_path / "tok/merges")).count() == 2
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "tok/special")).collect()} == {258}


def test_rank_file_and_text_sink(spark, tmp_path):
    words = [bytes([i]) for i in range(256)] + [b"th", b"the"]
    (tmp_path / "ranks").write_text("".join(f"{base64.b64encode(w).decode()} {i}\n" for i, w in enumerate(words)) + "\n")
    rows = sources.read_ranks(spark, str(tmp_path / "ranks")).orderBy("id").collect()
    assert [bytes(r["bytes"]) for r in rows] == words and [r["id"] for r in rows] == list(range(258))
    docs = spark.createDataFrame([(1, "en", "a"), (2, "fr", "é")], "doc_id long, lang string, text string").coalesce(1)
    path = sinks.write_corpus(docs, str(tmp_path / "out"), seed=1, n=2, source="s", as_text=True)
    assert sinks.write_corpus(docs.limit(1), str(tmp_path / "out"), seed=1, n=2, source="s", as_text=True) == path
    assert "".join(f.read_text("utf-8") for f in sorted((tmp_path / "out/s-seed1-n2").glob("part-*"))) == "a\né\n"


def test_languages(spark):
    docs = spark.createDataFrame([(1, "fr"), (2, None), (3, "en"), (4, "es")], "doc_id long, lang string")
    assert {r["doc_id"]: r["src_order"] for r in sources.union_by_language(docs).collect()} == {3: 0, 4: 1, 1: 2, 2: 3}
    assert {r["doc_id"]: r["src_order"] for r in sources.union_by_language(docs, ("fr", "en")).collect()} == {1: 0, 3: 1}


def test_offsets_of_nulls_and_ties(spark):
    rows = spark.createDataFrame([(None, 3), (5, 1), (5, 2), (5, 2), (1, 4)], "doc_id long, n long")
    found = order.with_offset(rows, "doc_id", F.col("n"), rows_per_part=2).orderBy("offset").collect()
    assert [r["doc_id"] for r in found] == [None, 1, 5, 5, 5]
    assert all(a["offset"] + a["n"] == b["offset"] for a, b in zip(found, found[1:])) and found[0]["offset"] == 0
    assert order.with_position(rows.limit(0), "doc_id").count() == 0


def test_broadcasts_are_bounded(spark):
    rows = spark.createDataFrame([("x" * 1000, [1.0] * 100)] * 50, "a string, b array<double>")
    hinted = lambda df: "BroadcastHashJoin" in rows.join(df, "a")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert hinted(small_side(rows)) and not hinted(small_side(rows, size=50_000)) and not hinted(small_side(rows, rows=49))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("limit", [10, 1])
def test_matched_is_a_left_join(spark, limit):
    """By broadcast or over salts: every row once, a hot key's too, whatever else is in it."""
    rows = spark.createDataFrame([("hot", i, None) for i in range(500)] + [("cold", 1, "y"), ("none", 2, None), (None, 3, None)], "k string, i long, salt string")
    table = spark.createDataFrame([("hot", 7), ("cold", None), ("unused", 9)], "k string, v long")
    found = sorted((r["i"], r["k"] or "", r["v"]) for r in matched(rows, table, "k", "i", "salt", limit=limit).collect() if r["k"] != "hot")
    assert found == [(1, "cold", None), (2, "none", None), (3, "", None)]
    hot = matched(rows, table, "k", "i", "salt", how="inner", limit=limit).where("k = 'hot'")
    assert hot.columns == ["k", "i", "salt", "v"] and sorted(r["i"] for r in hot.where("v = 7").collect()) == [*range(500)]


CONFIG = model.Config(block_size=6, vocab_size=16, n_layer=2, n_head=2, n_embd=8)


def some_weights(config=CONFIG):
    draw = np.random.default_rng(4)
    return {k: draw.normal(0, 0.5, s).astype(np.float32) for k, s in model.shapes(config).items()}


def plain_logits(ids, w, config=CONFIG):
    """The published model, position by position, with Python loops over layers, heads and keys."""
    c, d = config.n_embd, config.n_embd // config.n_head
    norm = lambda v, n: (v - v.mean()) / np.sqrt(((v - v.mean()) ** 2).mean() + 1e-5) * w[n + ".weight"] + w[n + ".bias"]
    affine = lambda v, n: np.array([float(r @ v) for r in w[n + ".weight"].astype(float)]) + w[n + ".bias"]
    x = [w["transformer.wte.weight"][i].astype(float) + w["transformer.wpe.weight"][p] for p, i in enumerate(ids)]
    for layer in range(config.n_layer):
        at = f"transformer.h.{layer}."
        qkv = [affine(norm(v, at + "ln_1"), at + "attn.c_attn") for v in x]
        mixed = []
        for p in range(len(ids)):
            heads = []
            for h in range(config.n_head):
                cut = lambda v, part, h=h: v[part * c + h * d : part * c + h * d + d]
                e = [math.exp(cut(qkv[p], 0) @ cut(qkv[s], 1) / math.sqrt(d)) for s in range(p + 1)]
                heads.append(sum(e[s] / sum(e) * cut(qkv[s], 2) for s in range(p + 1)))
            mixed.append(np.concatenate(heads))
        x = [v + affine(m, at + "attn.c_proj") for v, m in zip(x, mixed)]
        gelu = lambda v: 0.5 * v * (1 + np.tanh(math.sqrt(2 / math.pi) * (v + 0.044715 * v**3)))
        x = [v + affine(gelu(affine(norm(v, at + "ln_2"), at + "mlp.c_fc")), at + "mlp.c_proj") for v in x]
    return np.array([[float(row @ norm(v, "transformer.ln_f")) for row in w["transformer.wte.weight"].astype(float)] for v in x])


def test_model_by_loops(spark):
    w = some_weights()
    sequences = {1: [1, 2, 3], 2: [], 3: [4], 4: [15, 0, 7, 7, 2, 1]}
    rows = spark.createDataFrame(list(sequences.items()), "doc_id long, ids array<int>")
    for r in model.forward(rows, CONFIG, w).collect():
        ids = sequences[r["doc_id"]]
        assert r["n"] == len(ids)
        if ids:
            z = plain_logits(ids, w)
            assert r["next_id"] == z[-1].argmax()
            if len(ids) > 1:
                assert r["loss"] == pytest.approx(np.mean([np.log(np.exp(row).sum()) - row[t] for row, t in zip(z, ids[1:])]), abs=1e-3)
    with pytest.raises(Exception, match="over the block size"):
        model.forward(spark.createDataFrame([(1, [1] * 7)], "doc_id long, ids array<int>"), CONFIG, w).collect()
    with pytest.raises(ValueError):
        model.Config(n_head=5)


def test_generation_by_loops(spark):
    w = some_weights()
    prompts = spark.createDataFrame([(1, 1, [1, 2]), (1, 2, [1, 2]), (2, 1, [3]), (3, 1, [])], "id long, seq int, ids array<int>")
    u = {(r["id"], r["seq"], n): r[f"u{n}"] for r in prompts.select("id", "seq", *(sampling.uniform(42, F.col("id").cast("string"), F.col("seq").cast("string"), F.lit(str(n))).alias(f"u{n}") for n in range(6))).collect() for n in range(6)}
    for r in model.generate(prompts, CONFIG, w, length=5, k=4).collect():
        ids = {1: [1, 2], 2: [3], 3: []}[r["id"]]
        while 0 < len(ids) < 5:
            z = plain_logits(ids, w)[-1]
            best = sorted(range(16), key=lambda i: (-z[i], i))[:4]
            p = [math.exp(z[i] - z.max()) for i in best]
            goal, total = u[r["id"], r["seq"], len(ids)] * sum(p), 0.0
            for i, v in zip(best, p):
                total += v
                if total >= goal:
                    break
            ids = ids + [i]
        assert r["ids"] == ids


def test_checkpoint_fills_the_model(spark, tmp_path):
    w = some_weights()
    stored = {k: v.T.copy() if k.endswith(model.TRANSPOSED) else v for k, v in w.items()} | {"transformer.h.0.attn.bias": np.zeros((1, 1))}
    model.weight_table(spark, stored).write.parquet(str(tmp_path / "weights"))
    own = model.own_names(spark, CONFIG)
    found = model.load_weights(model.match_checkpoint(own, sources.read_weights(spark, str(tmp_path / "weights"))))
    assert set(found) == set(w) and all(np.array_equal(found[k], w[k]) for k in w)
    for wrong in ({k: v for k, v in stored.items() if "wpe" not in k}, stored | {"other": np.zeros(2)}, stored | {"transformer.wpe.weight": np.zeros((2, 2))}):
        with pytest.raises(Exception, match="no match for"):
            model.match_checkpoint(own, model.weight_table(spark, wrong)).collect()
    with pytest.raises(ValueError):
        model.load_weights(model.weight_table(spark, w), limit=10)


def test_attention_and_head_in_blocks(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(23, 4))
    rows = spark.createDataFrame([(int(i % 2), int(i // 2), int(i), x[i].tolist()) for i in range(23)], "label int, pos long, vec_id long, x array<double>")
    for r in attention.causal(rows, block=3).collect():
        keys = [j for j in range(23) if j % 2 == r["vec_id"] % 2 and j <= r["vec_id"]]
        e = np.exp(x[keys] @ x[r["vec_id"]] / 2)
        assert r["keys"] == len(keys) and np.allclose(r["mixed"], e @ x[keys] / e.sum())
    states = rows.select("vec_id", "x")
    tokens = states.unionByName(states.selectExpr("vec_id + 100 AS vec_id", "x")).withColumnRenamed("vec_id", "token")  # ties
    found = attention.likeliest(states, tokens, state_block=4, token_block=5).collect()
    assert len(found) == 23 and all(r["token"] % 100 == (x @ x[r["vec_id"]]).argmax() for r in found)
    assert attention.likeliest(states, tokens.limit(0)).count() == 0


def test_every_target_is_scored_once(spark):
    from loomtext.plans.kernels import TINY, score_windows

    draw = random.Random(6)
    weights, block = model.random_weights(TINY), TINY.block_size
    texts = {n: [draw.randrange(256) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 66, 128, 129, 200)}
    found = {r["doc_id"]: r for r in score_windows(spark.createDataFrame(list(texts.items()), "doc_id long, ids array<int>"), weights).collect()}
    for n, ids in texts.items():
        losses = []
        for start in range(0, n - 1, block):
            x, y = ids[start : start + block], ids[start + 1 : start + block + 1]
            z = model.logits(TINY, weights, np.array([x[: len(y)]]))[0]
            losses += [np.log(np.exp(row).sum()) - row[t] for row, t in zip(z, y)]
        assert len(losses) == max(0, n - 1) and found[n]["tokens"] == n
        assert found[n]["loss"] == (pytest.approx(np.mean(losses), abs=1e-5) if losses else None)


def test_stream(spark, tmp_path):
    merges = [(97, 97, 256)]
    rows = spark.createDataFrame([(1, "aaa", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        encode.encode_stream(encode.read_documents(spark, str(tmp_path / "in")), merges, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r["ids"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [[256, 97]]
