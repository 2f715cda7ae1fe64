"""What tasks hold and repeat must follow their batches, not the tables."""

import random

import numpy as np
import pandas as pd
import pytest

from loomtext.functions import merging as M
from loomtext.plans import tokens


def plain_merges(ids, merges):
    """Lowest rank first, left to right, until no pair is known."""
    ids, ranks = list(ids), {(a, b): (i, new) for i, (a, b, new) in reversed(list(enumerate(merges)))}
    while known := [ranks[p] for p in zip(ids, ids[1:]) if p in ranks]:
        rank, new = min(known)
        a, b, _ = merges[rank]
        out, i = [], 0
        while i < len(ids):
            pair = ids[i : i + 2] == [a, b]
            out.append(new if pair else ids[i])
            i += 2 if pair else 1
        ids = out
    return ids


@pytest.mark.parametrize("rounds", [1, 3, 48])
def test_parts_merge_as_whole_texts_do(rounds, monkeypatch):
    draw = random.Random(rounds)
    monkeypatch.setattr(M, "ROUNDS", rounds)
    for trial in range(300):
        letters, merges = draw.randrange(1, 5), {}
        for new in range(10, 10 + draw.randrange(1, 12)):
            known = [*range(letters), *(m[2] for m in merges.values())]
            pair = draw.choice(known), draw.choice(known)
            merges.setdefault(pair, (*pair, new))
        merges = list(merges.values())
        if trial % 5 == 0:
            draw.shuffle(merges)  # ranks that don't follow the making of ids
        texts = [[draw.randrange(letters + (trial % 3 == 0) * 30) for _ in range(draw.randrange(30))] for _ in range(draw.randrange(1, 6))]
        table, bounds = M.MergeTable(merges), M.bounds_of([len(t) for t in texts])
        for cells in (table.cells, None):
            table.cells = cells
            ids, cuts = table.encode(np.array([i for t in texts for i in t], np.int64), bounds)
            assert [ids[i:j].tolist() for i, j in zip(cuts, cuts[1:])] == [plain_merges(t, merges) for t in texts]


def test_short_words_need_no_pass_for_each_rank(monkeypatch):
    """Words apart are done in as many rounds as the longest has merges, however many ranks there are."""
    draw = random.Random(1)
    merges = [(i % 64, 64 + i // 64, 1_000 + i) for i in range(2_000)]
    words = [(a, b) for a, b, _ in merges] * 3
    draw.shuffle(words)
    text = np.array([i for w in words for i in (*w, 999)], np.int64)
    monkeypatch.setattr(M.MergeTable, "_by_rank", None)
    ids, _ = M.MergeTable(merges).encode(text, np.array([0, len(text)]))
    names = {(a, b): new for a, b, new in merges}
    assert ids.tolist() == [i for w in words for i in (names[w], 999)]


def test_workers_get_small_batches(spark, tmp_path):
    """Batches are bounded in rows and in bytes, so a worker's memory doesn't follow the table."""
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    held = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "10000")
        spark.range(6_000).selectExpr("id AS doc_id", "repeat('word ', IF(id < 4000, 1, 4000)) AS text", "'en' AS lang").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))

        def seen(batches):
            for batch in batches:
                yield pd.DataFrame({"n": [len(batch)], "size": [int(batch["text"].str.len().sum())]})

        found = tokens._documents(spark, str(tmp_path)).mapInPandas(seen, "n long, size long").collect()
        assert sum(r["n"] for r in found) == 6_000
        assert max(r["n"] for r in found) <= 1_000 and max(r["size"] for r in found) < 8 << 20
    finally:
        for key, value in zip(keys, held):
            spark.conf.set(key, value)


def test_windows_are_cut_in_the_tasks(spark):
    """Windows of a document never become rows, and scores too large for a bare exponential are shifted."""
    from loomtext.operators import model
    from loomtext.plans.kernels import TINY, score_windows

    draw = random.Random(3)
    texts = {n: [draw.randrange(256) for _ in range(n)] for n in (0, 1, 2, 65, 200, 1_000)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, ids array<int>")
    for scale in (1, 30):
        weights = {k: v * np.float32(scale) if k.endswith("wte.weight") else v for k, v in model.random_weights(TINY).items()}
        scored = score_windows(rows, weights)
        assert "Generate" not in scored._jdf.queryExecution().toString()
        for r in scored.collect():
            ids, found = texts[r["doc_id"]], []
            for start in range(0, len(ids) - 1, TINY.block_size):
                x, y = ids[start : start + TINY.block_size], ids[start + 1 : start + TINY.block_size + 1]
                z = model.logits(TINY, weights, np.array([x[: len(y)]]))[0].astype(float)
                found += [z[i].max() + np.log(np.exp(z[i] - z[i].max()).sum()) - z[i][t] for i, t in enumerate(y)]
            assert r["tokens"] == len(ids) and r["loss"] == (pytest.approx(np.mean(found), rel=1e-5) if found else None)


def test_the_model_reads_the_bytes_of_texts(spark, tmp_path):
    """Bytes go to the model as they are: no step makes an array of ids of them first."""
    from loomtext.operators import model
    from loomtext.plans import kernels

    texts = {1: "é" * 100, 2: "", 3: None, 4: "x", 5: "word " * 77}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    scored = kernels.model_forward(spark, str(tmp_path))
    assert "EvalPython" not in scored._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(k, list((t or "").encode())) for k, t in texts.items()], "doc_id long, ids array<int>")
    expected = {r["doc_id"]: (r["n"], r["targets"], r["loss"]) for r in model.losses(rows, kernels.TINY, kernels.tiny_weights(spark)).collect()}
    for r in scored.collect():
        n, targets, loss = expected[r["doc_id"]]
        assert n == len((texts[r["doc_id"]] or "").encode()) == r["tokens"] and r["loss"] == (pytest.approx(loss / targets, abs=2e-6) if targets else None)
    assert scored.count() == len(texts)


def test_training_guesses_its_pairs(spark, monkeypatch):
    """No round starts with far more pairs than the merges wanted or the run ids allow, so none is thrown away."""
    from loomtext.operators import bpe

    draw, asked = random.Random(8), []
    docs = spark.createDataFrame([(i, "".join(draw.choice("abcdefghijklmnop ") for _ in range(400))) for i in range(50)], "doc_id long, text string")
    plain = bpe.train_stream(docs, 40)
    runs_of = bpe.runs_of
    monkeypatch.setattr(bpe, "runs_of", lambda rows, pairs: asked.append(len(pairs)) or runs_of(rows, pairs))
    assert bpe.train_stream(docs, 3) == plain[:3] and max(asked) <= 24
    asked.clear()
    assert bpe.train_stream(docs, 40, run_ids=3_000) == plain
    assert asked[0] <= 64


def test_pairs_are_summed_with_their_first_places():
    draw = np.random.default_rng(2)
    for ordered in (True, False):
        for weighted in (True, False):
            lengths = draw.integers(0, 9, 40)
            ids, bounds = draw.integers(0, 5, lengths.sum()), M.bounds_of(lengths)
            weights = draw.integers(1, 4, 40) if weighted else np.ones(40, np.int64)
            places = np.arange(40) << 32 if ordered else draw.permutation(40).astype(np.int64) << 32
            sums, firsts = {}, {}
            for i in range(40):
                text = ids[bounds[i] : bounds[i + 1]].tolist()
                for pos, (a, b) in enumerate(zip(text, text[1:])):
                    sums[a << 32 | b] = sums.get(a << 32 | b, 0) + int(weights[i])
                    firsts[a << 32 | b] = min(firsts.get(a << 32 | b, 1 << 62), int(places[i]) + pos)
            code, n, least = M.sum_pairs(ids, bounds, weights, places)
            assert dict(zip(code.tolist(), n.tolist())) == sums and dict(zip(code.tolist(), least.tolist())) == firsts


def test_tasks_send_sums_of_all_they_read(spark, monkeypatch):
    """Pairs leave a task once, whatever it reads, and rare ones not at all; merges stay those of a full count."""
    from pyspark.sql import functions as F

    from loomtext.operators import bpe

    draw = random.Random(9)
    docs = spark.createDataFrame([(i, "".join(draw.choice("aaabbcde ") for _ in range(60))) for i in range(300)], "doc_id long, text string").repartition(3)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = bpe.train_stream(docs, 60)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
        kept = bpe.rewritten(bpe.encoded_rows(docs), [(97, 98, 256)], 40).localCheckpoint()
        assert kept.where("pairs IS NOT NULL").count() == 3 and kept.where("ids IS NOT NULL").count() == 300
        exact = {(r["a"], r["b"]): r["cnt"] for r in bpe.pair_sums(kept.where("ids IS NOT NULL")).collect()}
        best, missed = bpe.heaviest(kept, 1_000, 40)
        found = {(a, b): n for a, b, n in best}
        assert missed == 120 and len(found) < len(exact) and all(found.get(p, 0) <= n <= found.get(p, 0) + missed for p, n in exact.items())
        for part in (1, 4):  # so much is left out that rounds count anew
            monkeypatch.setattr(bpe, "MISSED", part)
            assert bpe.train_stream(docs, 60, hot=5) == plain
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_repeated_runs_are_merged_and_summed_once():
    draw = np.random.default_rng(7)
    for trial in range(200):
        merges, known = [], [*range(draw.integers(1, 6))]
        for new in range(10, 10 + draw.integers(1, 12)):
            merges.append((int(draw.choice(known)), int(draw.choice(known)), new))
            known.append(new)
        merges = [m for i, m in enumerate(merges) if m[:2] not in [x[:2] for x in merges[:i]]]
        lengths = draw.integers(0, 40, 6)
        ids, bounds = draw.integers(0, 5 + trial % 20, lengths.sum()), M.bounds_of(lengths)
        table = M.MergeTable(merges)
        for x, y in zip(table.encode(ids, bounds), table.encode_repeated(ids, bounds)):
            assert np.array_equal(x, y)
        pairs = {m[:2] for m in merges}
        expected = []
        for s, e in zip(bounds, bounds[1:]):
            at = s
            while at < e:
                end = at
                while end + 1 < e and (ids[end], ids[end + 1]) in pairs:
                    end += 1
                if end > at:
                    expected.append((at, end))
                at = end + 1
        first, last = M.PairSet(list(pairs)).runs(ids, bounds)
        assert list(zip(first.tolist(), last.tolist())) == expected
        weight, place = draw.integers(1, 3 if trial % 2 else 2, len(first)), draw.permutation(len(first))
        sums = {}
        for s, e, w, p in zip(first, last, weight, place):
            known_run = sums.setdefault(ids[s : e + 1].astype(np.uint16).tobytes(), [0, p])
            known_run[0], known_run[1] = known_run[0] + w, min(known_run[1], p)
        found = [(r, w, place[i]) for runs, sums_, at in M.distinct_runs(ids.astype(np.uint16), first, last, weight, (place,)) for r, w, i in zip(runs, sums_, at)]
        assert len(found) == len(sums) and {r: [w, p] for r, w, p in found} == sums
        counts, weights = {}, draw.integers(1, 4, 6)
        for k, (s, e) in enumerate(zip(bounds, bounds[1:])):
            for a, b in zip(ids[s:e], ids[s + 1 : e]):
                counts[a << 16 | b] = counts.get(a << 16 | b, 0) + 2 * weights[k] + 1
        added = M.PairSums(50)
        for w in (weights, np.ones(6, np.int64), weights):
            added.add(ids, bounds, w)
        assert dict(zip(*(x.tolist() for x in added.result()))) == counts


def test_tokens_in_order_are_shuffled_as_stretches(spark):
    """What is shuffled for a document follows its batches, not its tokens; tokens in any order come out in theirs."""
    from pyspark.sql import functions as F

    from loomtext.operators import bpe

    texts = {1: b"a long text " * 500, 2: b"", 3: bytes(range(256)), None: b"x"}
    rows = [(k, i, b) for k, t in texts.items() for i, b in enumerate(t)]
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, id int").coalesce(1)
    packed = tokens.select("doc_id", "pos", F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("bytes")).mapInArrow(bpe._laid_end_to_end, "doc_id long, pos int, bytes binary")
    assert sorted((r["doc_id"] or 0, r["pos"], bytes(r["bytes"])) for r in packed.collect()) == [(0, 0, b"x"), (1, 0, texts[1]), (3, 0, texts[3])]
    docs = spark.createDataFrame([(1, True), (2, True), (3, True)], "doc_id long, encoded boolean")
    for some in (tokens, tokens.orderBy(F.rand(1)), tokens.repartition(5, "pos")):
        found = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode_join(some, bpe.vocabulary(spark, []), docs).collect()}
        assert found == {k: texts[k] for k in (1, 2, 3)}


def test_pieces_are_encoded_once(spark):
    """Ids and what they decode to come from one encoding; null and empty texts, pieces and arrays stay apart."""
    from pyspark.sql import functions as F

    from loomtext.operators import bpe

    codec = bpe.Codec([(97, 98, 256), (256, 99, 257)], whole={b"xyz": 300})
    rows = [(1, ["abc", "ab", "abc"]), (2, []), (3, None), (4, ["xyz", None, "", "zü"]), (5, ["c"])]
    docs = spark.createDataFrame(rows, "id int, pieces array<string>").coalesce(1)
    ids = docs.select("id", codec.encode_pieces("pieces").alias("ids"))
    found = {r["id"]: (r["ids"], r["back"]) for r in ids.select("id", "ids", codec.decode("ids").alias("back")).collect()}
    assert found == {1: ([257, 256, 257], "abcababc"), 2: ([], ""), 3: (None, None), 4: ([300, 122, 195, 188], "xyzzü"), 5: ([99], "c")}
    plan = ids.select("id", F.size("ids"), codec.decode("ids"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("encode_pieces(") == 1


def test_states_are_scored_in_stretches(spark, monkeypatch):
    from loomtext.operators import attention

    monkeypatch.setattr(attention, "BLOCK", 3)  # no block of states is a multiple of it
    x = np.random.default_rng(5).normal(size=(40, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>")
    found = attention.likeliest(rows, rows.withColumnRenamed("vec_id", "token"), state_block=20, token_block=17).collect()
    assert {r["vec_id"]: r["token"] for r in found} == dict(enumerate((x @ x.T).argmax(axis=1).tolist())) and len(found) == 40


def test_vectors_are_shuffled_once(spark, monkeypatch):
    """However many blocks there are, no vector is repeated in a shuffle; the best of all stretches of all blocks is found."""
    from loomtext.operators import attention

    monkeypatch.setattr(attention, "BLOCK", 4)
    monkeypatch.setattr(attention, "TOKENS", 3)
    x = np.random.default_rng(6).integers(-9, 10, (60, 4)).astype(float)
    x[40:50] = x[20:30]  # ties within blocks and across
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>").repartition(3)
    for state_block, token_block in ((10, 7), (100, 100)):
        found = attention.likeliest(rows, rows.withColumnRenamed("vec_id", "token"), state_block=state_block, token_block=token_block)
        assert "Generate" not in found._jdf.queryExecution().analyzed().toString()
        best = {r["vec_id"]: (r["token"], r["logit"]) for r in found.collect()}
        assert best == {i: (int((x @ v).argmax()), float((x @ v).max())) for i, v in enumerate(x)}


def test_streamed_rows_are_cut_outside_lambdas(spark, tmp_path):
    """Blocks are numbered out and cut in compiled code, not sliced row by row in a lambda."""
    from loomtext.operators import bpe
    from loomtext.streaming import pack

    feed, schema = str(tmp_path / "feed"), "lang string, doc_id long, text string"
    text = "".join(chr(97 + i % 26) for i in range(3 * pack.BLOCK + 5))
    spark.createDataFrame([("en", 1, text)], schema).write.parquet(feed)
    packed = pack.pack_stream(spark.readStream.schema(schema).parquet(feed), ["lang"], 8, bpe.Codec([]))
    assert "lambdafunction" not in packed._jdf.queryExecution().analyzed().toString()
    pack.write_rows(packed, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = {r["row"]: (bytes(r["x"]), bytes(r["y"])) for r in spark.read.schema(packed.schema).parquet(str(tmp_path / "out")).collect()}
    raw = text.encode()
    assert found == {i: (raw[8 * i : 8 * i + 8], raw[8 * i + 1 : 8 * i + 9]) for i in range((len(raw) - 1) // 8)}


def test_a_batch_store_computes_each_row_once(spark, tmp_path):
    """Rows are packed once for the store, kept once in the order of batches, and weighed once however many steps they are in."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from loomtext.operators import packing

    packed_rows, weighed_rows = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(rows):
        def passed(v):
            rows.add(1)
            return v

        return F.udf(passed, "int").asNondeterministic()

    b, t, n = 2, 4, 60
    ids = list(range(n * b * t + 1))
    rows = [(i // b, i % b, ids[i * t : i * t + t], ids[i * t + 1 : i * t + t + 1]) for i in range(n * b)]
    random.Random(4).shuffle(rows)
    packed = spark.createDataFrame(rows, "batch long, row int, x array<int>, y array<int>").repartition(3)
    store = packing.BatchStore.write(packed.withColumn("row", counted(packed_rows)("row")), str(tmp_path / "store"), n, b, t, span_tokens=b * t * 20)
    assert packed_rows.value == len(rows)
    files = list((tmp_path / "store" / "rows").glob("span=*/*.parquet"))
    places = [[(r["batch"], r["row"]) for r in pq.ParquetFile(f).read(columns=["batch", "row"]).to_pylist()] for f in files]
    assert all(p == sorted(p) for p in places) and sorted(sum(places, [])) == [(i // b, i % b) for i in range(n * b)]
    assert {c for f in files for c in pq.ParquetFile(f).schema_arrow.names} == {"batch", "row", "x", "next"}
    found = store.between(3, 3 + 4 * n, counted(weighed_rows)(F.element_at("y", -1)).alias("end")).collect()
    assert weighed_rows.value == len(rows)
    assert sorted(tuple(r) for r in found) == [(s, r, ids[(s % n) * b * t + r * t + t]) for s in range(3, 3 + 4 * n) for r in range(b)]
