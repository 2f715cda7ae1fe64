"""The pipeline's stages, each held against a plain recomputation of what it decides."""

import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import mixing, toxicity
from tests.conftest import SF
from tests.llm.test_operators import make

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = dict(corpus_pipeline.STAGES)


def texts_of(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def shingles(text):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_groups(texts):
    """Groups of texts that chains of Jaccard similarity of 0.8 or more join, all pairs compared."""
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_toxicity_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    kept = texts_of(STAGES["toxicity"](spark, docs, SF).collect())
    want = Counter()
    for r in docs.collect():
        slots, _ = toxicity.features([r["text"]])
        score = float(model.weights[slots].sum())
        if sum(1 / (1 + math.exp(t - score)) for t in model.thresholds) < toxicity.REJECT_FROM:
            want[r["doc_id"], r["text"]] += 1
    assert kept == want and 0 < kept.total() < docs.count()


def test_quality_stage(spark, tmp_path):
    """What stays is what the operator, tested by brute force, keeps; here that rows come back whole."""
    draw = random.Random(2)
    good = [" ".join(draw.choice(["sun", "tree", "river", "walks", "quiet", "old"]) for _ in range(50)) for _ in range(60)]
    docs = make(spark, [*good, *["$$$ WIN!! $$$ %% WIN!!"] * 30, None, ""]).withColumn("kept", F.lit("own"))
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 90, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = STAGES["quality"](spark, docs, str(tmp_path))
    assert found.columns == docs.columns and {r["kept"] for r in found.collect()} == {"own"}
    assert {r["doc_id"] for r in found.collect()} == {*range(60), 90, 91}


def test_near_duplicate_stage(spark):
    draw = random.Random(4)
    base = [" ".join(f"w{draw.randrange(900)}" for _ in range(60)) for _ in range(8)]
    texts = [t for b in base for t in (b, b, b.upper(), b + " and one more", " ".join(b.split()[:30]))] + [None, "", "!?", "a b c", "A B C."]
    docs = make(spark, texts, ids=[3 * i % 101 for i in range(len(texts))])
    rows = STAGES["near_duplicates"](spark, docs, SF).collect()
    groups = {}
    for i, g in enumerate(near_groups(texts)):
        groups.setdefault(g, []).append((3 * i % 101, texts[i]))
    assert texts_of(rows) == Counter(min(members, key=lambda m: m[0]) for members in groups.values())


@pytest.mark.parametrize("others", [0, 5])
def test_repeated_rows_stay_once(spark, others):
    """Rows of equal doc_id and text are one document, null or not, whatever other rows there are."""
    texts, ids = [None, None, None, "", "", "a b c", "a b c"], [1, 1, None, 2, 2, 3, 3]
    texts, ids = texts + ["z y x"] * others, ids + [50] * others
    docs = make(spark, texts, ids=ids).withColumn("own_id", F.lit("own")).withColumn("repeats", F.lit("own"))
    rows = STAGES["near_duplicates"](spark, docs, SF)
    assert rows.columns == docs.columns
    assert texts_of(rows.collect()) == Counter({k: 1 for k in zip(ids, texts)})


def test_mixing_stage(spark):
    docs = make(spark, ["x" * 300] * 50 + ["y"] * 30 + [None] * 4, sources=["a"] * 50 + ["b"] * 30 + [None] * 4)
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(r["text"] or "") + 1
    whole = sum(v**mixing.EXPONENT for v in sizes.values())
    want = Counter()
    for r in docs.collect():
        rate = round(sizes[r["source"]] ** mixing.EXPONENT / whole * sum(sizes.values()) / sizes[r["source"]], 9)
        u, n, total = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 16**13, 0, math.exp(-rate)
        while total <= u:
            n += 1
            total += math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
        want[r["doc_id"], r["text"]] = n
    found = STAGES["mixing"](spark, docs, SF)
    assert found.columns == docs.columns and texts_of(found.collect()) == +want


def test_encoding_stage(spark):
    ranks = dict((__import__("base64").b64decode(a), int(b)) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = make(spark, ["Hello there <|endoftext|>  you\n\n", "é 日本 😀", None, "", "x " * 20_000])
    rows = {r["doc_id"]: r for r in STAGES["byte_bpe"](spark, docs, SF).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        ids = library.encode_ordinary(text)
        found = rows[r["doc_id"]]
        assert found["ids"] == ids and found["n_tokens"] == len(ids) and found["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_over_the_table(spark):
    """Each stage over all that the one before it kept: columns and texts stay as they are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        assert docs.columns == columns and all(held[r["doc_id"]] == r["text"] for r in rows)
        if name != "mixing":
            assert len(rows) < before and max(Counter(r["doc_id"] for r in rows).values()) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_run_over_odd_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for name, texts in (("empty", []), ("odd", [None, "", "a b c", "a b c", "x " * 50_000])):
        folder = f"{tmp_path}/{name}"
        make(spark, texts, ids=[None, 1, 2, 2, 3][: len(texts)]).select(*COLUMNS).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        # Without labels nothing is rejected; the near copy of one row goes, and one source is drawn about once a row.
        known = {hashlib.sha256((t or "").encode()).hexdigest(): t for t in texts}
        assert {r["decoded_sha256"] for r in rows} <= set(known) and len(rows) <= 12
