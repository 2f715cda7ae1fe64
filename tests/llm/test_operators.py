"""Each operator against brute force, and its defined cases."""

import functools
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomtext.llm import components, fingerprint, jaccard, mixing, pq, quality, sampling, sharding, token_count, tokens, toxicity, warc
from loomtext.llm.queries import ORACLES, QUERIES, byte_bpe
from loomtext.llm.bpe_codec import Codec, serialise
from loomtext.session import matched, small_batches
from tests.conftest import SF, same_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, node long, label string, rate double, h long, bucket int"
LONG = " ".join(f"word{i % 977} number{i}" for i in range(30_000))


def make(spark, texts, ids=None, sources=None):
    """Documents with extra columns named like the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", (sources[k] if sources else "s"), None if t is None else len(t), 7, 7, "x", 0.5, 1, 2) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


ODD = ["", None, "one", "one", "Hello there <|endoftext|> you", LONG, "é 日本 😀 \x00 \U0003d000't", "a\n\na\n", "  "]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, duck):
    same_rows(QUERIES[name](spark, SF), duck.sql(ORACLES[name]))


# Fingerprints


def test_fingerprints_by_brute_force(spark):
    draw = random.Random(2)
    texts = ODD + ["\n".join(f"line {draw.randrange(50)} of this text" for _ in range(draw.randrange(1, 60))) for _ in range(60)]
    docs = make(spark, texts, ids=[3 * i for i in range(len(texts))])
    found = {r["doc_id"]: r for r in fingerprint.fingerprints(docs.repartition(5)).collect()}
    order = sorted(found, reverse=True)
    texts = {3 * i: t or "" for i, t in enumerate(texts)}
    assert len(found) == len(texts)
    for k, i in enumerate(order):
        following = texts[order[(k + 1) % len(order)]]
        third = len(texts[i]) // 3
        changed = texts[i][: len(texts[i]) - third] + following[:third]
        assert found[i]["n_chars"] == len(texts[i])
        assert found[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        for other, score in ((changed, found[i]["near_edited"]), (following, found[i]["near_next"])):
            a, b = (Counter(fingerprint.paragraphs(t)) for t in (texts[i], other))
            union = sum((a | b).values())
            assert score == pytest.approx(sum((a & b).values()) / union if union else 1.0)
    assert found[6]["fingerprint"] == found[9]["fingerprint"]


def test_sketches_subtract_and_recover():
    draw = np.random.default_rng(1)
    common = draw.integers(0, 1 << 63, 500).astype(np.uint64)
    left, right = common[:480], common[20:]
    (a, b), (c, d) = fingerprint.differing([left, common[:0]], [right, common[:0]])
    assert set(a) == set(common[:20]) and set(b) == set(common[480:]) and not len(c) and not len(d)


def test_fingerprints_of_few_rows(spark):
    assert fingerprint.fingerprints(make(spark, [])).count() == 0
    one = fingerprint.fingerprints(make(spark, ["abcdef"])).collect()
    assert [r["near_next"] for r in one] == [1.0] and one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    repeated = fingerprint.fingerprints(make(spark, ["x", "x", "y", "z"], ids=[1, 1, None, None]))
    assert repeated.count() == 4


def test_fingerprint_stretches_join_up(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_BYTES", 200)
    texts = [f"text {i}\n" + "x" * i for i in range(80)]
    found = {r["doc_id"]: r for r in fingerprint.fingerprints(make(spark, texts)).collect()}
    for i in range(80):
        assert found[i]["edited_sha256"] == hashlib.sha256(fingerprint.edited(texts[i], texts[(i - 1) % 80]).encode()).hexdigest()
    assert len(found) == 80


@pytest.mark.parametrize("text", ["A short text of one line, edited in its last third only", "seven words are in this short text", "漢字" + "".join(chr(0x4E00 + i * 37 % 999) for i in range(80))])
def test_short_texts_share_paragraphs_with_their_edits(text):
    near = fingerprint.compare([text, "z" * len(text)])["near_edited"][0]
    assert 0.25 <= near < 1


def test_an_early_insertion_moves_few_paragraphs():
    draw = random.Random(4)
    for text in (" ".join(str(draw.randrange(10**5)) for _ in range(500)), "".join(draw.choice("abcdefgh") for _ in range(3000))):
        a, b = (Counter(fingerprint.paragraphs(t)) for t in (text, text[:100] + "inserted" + text[100:]))
        assert sum((a & b).values()) / sum((a | b).values()) > 0.8
        assert "".join(fingerprint.paragraphs(text)) == text


# Sharding


def test_sharding(spark):
    draw = random.Random(5)
    texts = [*ODD, *("t" * draw.randrange(3000) + str(draw.randrange(9)) for _ in range(500)), *["copy"] * 50]
    rows = sharding.assign(make(spark, texts), 8).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(range(len(texts)))
    load, slots, where = [0] * 8, defaultdict(list), defaultdict(set)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[text].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    longest = len(LONG) + 1
    rest = [x for x in load if x < longest]
    assert max(rest) - min(rest) < 0.01 * sum(rest)
    # Longest processing time, group by group: these groups of over 4 kB are alone in their size class, so exact too.
    groups, plain = Counter(), [0] * 8
    for text in texts:
        groups[text or ""] += len((text or "").encode()) + 1
    for size in sorted(groups.values(), reverse=True):
        plain[plain.index(min(plain))] += size
    assert sorted(load) == sorted(plain)
    assert sharding.assign(make(spark, []), 8).count() == 0


def test_bulk_deal_is_the_heap():
    classes = [(1, 5, 900.0), (2, 7, 40.0), (3, 4000, 3.0), (4, 333, 1.0)]
    load = [0.0] * 8
    for _, n, size in classes:
        for _ in range(n):
            load[load.index(min(load))] += size
    dealt = sharding.deal(classes, 8)
    ours = [sum(given[s] * size for (_, given), (_, _, size) in zip(dealt, classes)) for s in range(8)]
    assert sorted(ours) == sorted(load) and all(sum(g) == n for (_, g), (_, n, _) in zip(dealt, classes))


# Mixing


def test_mixing(spark):
    texts = ["x" * 100] * 400 + ["y" * 100] * 100 + ["z"] * 3
    docs = make(spark, texts, sources=["a"] * 400 + ["b"] * 100 + [None] * 3)
    rates = mixing.rates(docs, weights={"a": 1.0, "b": 1.0, "": 0.0})
    rows = mixing.replicate(docs, rates).collect()
    held = Counter(r["source"] for r in rows)
    assert abs(held["a"] - 250) < 60 and abs(held["b"] - 250) < 60 and not held[None]
    assert {(r["doc_id"], r["mix_copy"]) for r in rows} == {(r["doc_id"], k + 1) for r in rows for k in range(r["mix_copies"])}
    assert mixing.replicate(make(spark, []), mixing.rates(make(spark, []))).count() == 0
    assert "rate" in mixing.replicate(docs, rates).columns


def test_mixing_counts_and_clashing_names(spark):
    """Counts by summing the distribution at the hashed number; columns named like ours, and those of the join, survive."""
    names = ["mix_source", "mix_steps", "mix_u", "source_key", "row", "known", "copies", "copy", "key"]
    docs = make(spark, [f"t{i}" for i in range(60)], ids=[*range(58), 7, None], sources=["a", "b", None] * 20)
    docs = docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names), F.lit("own").alias("mix_rate"))
    rates = {"a": 0.4, "b": 2.5, "": 40.0}
    table = spark.createDataFrame(list(rates.items()), "source_key string, rate double")
    rows = mixing.replicate(docs, table).collect()
    held = Counter((r["doc_id"], r["text"]) for r in rows)
    for i, r in enumerate(docs.collect()):
        known = "null" if r["doc_id"] is None else str(r["doc_id"])
        u = int(hashlib.md5(f"{mixing.SEED}:{known}".encode()).hexdigest()[:13], 16) / 16**13
        rate, n, total = rates[r["source"] or ""], 0, 0.0
        while True:
            total += math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
            if total > u:
                break
            n += 1
        assert held[r["doc_id"], r["text"]] == n
    assert all(r[n] == f"own {n}" for r in rows for n in names) and {r["mix_rate"] for r in rows} <= set(rates.values())
    same = mixing.replicate(docs, table, added=False)
    assert same.columns == docs.columns and {r["mix_rate"] for r in same.collect()} == {"own"} and same.count() == len(rows)


def test_poisson_steps():
    for rate in (0.3, 5.0, 900.0, 1e6):
        first, steps = mixing.poisson_steps(rate)
        p = np.diff(np.concatenate([[0], steps]))
        assert (p * (first + np.arange(len(p)))).sum() == pytest.approx(rate, rel=1e-6)
        assert len(steps) <= 80 * math.sqrt(rate) + 90
    assert len(mixing.poisson_steps(0.0)[1]) == 0
    draws = mixing.poisson_counts(np.full(20_000, 1e6), np.random.default_rng(1).random(20_000))
    assert abs(draws.mean() - 1e6) < 50 and abs(draws.std() - 1e3) < 30


# Tokens


def test_token_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    vocabulary = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text("utf-8")
    library = Tokenizer.from_str(vocabulary)
    docs = make(spark, ODD)
    found = docs.select("doc_id", token_count.token_count(docs, F.col("text"), vocabulary).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in found} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD)}
    empty = make(spark, [])
    assert empty.select(token_count.token_count(empty, F.col("text"), vocabulary)).count() == 0


def test_codec_is_tiktokens(spark):
    import tiktoken

    content = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    codec = Codec(content, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    bpe = byte_bpe(spark)
    rows = make(spark, ODD).select("doc_id", bpe.encode(F.col("text")).alias("ids"), bpe.round_trip(F.col("text")).alias("both"))
    for r in rows.withColumn("back", bpe.decode(F.col("ids"))).collect():
        text = ODD[r["doc_id"]] or ""
        assert r["ids"] == r["both"]["ids"] == library.encode_ordinary(text)
        assert bytes(r["back"]) == bytes(r["both"]["decoded"]) == text.encode()
    draw = random.Random(4)
    for _ in range(500):
        text = "".join(draw.choice("ab's  \n\té日क्՘\x85😀<|endoftext|>12") for _ in range(draw.randrange(50)))
        assert codec.encode(text) == library.encode_ordinary(text)
    with pytest.raises(ValueError):
        serialise({b"a": 0, b"b": 2})


def test_equal_digests_end(spark):
    """Sets that can't peel, and some that do at once, after one failure or at once in a large sketch."""
    draw = np.random.default_rng(3)
    some = lambda n: draw.integers(0, 1 << 63, n, dtype=np.uint64)
    both, one = some(300), some(2)
    left = [np.repeat(one, 2), np.repeat(one, [1, 3]), np.concatenate([both, one]), some(2000), some(0), both]
    right = [one, np.repeat(one, [2, 1]), both, some(1500), some(5), both]
    for (a, b), x, y in zip(fingerprint.differing(left, right), left, right, strict=True):
        ours, theirs = Counter(x.tolist()), Counter(y.tolist())
        assert Counter(a.tolist()) == ours - theirs and Counter(b.tolist()) == theirs - ours


# Embeddings


def test_near_vectors_by_brute_force(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 16))
    vectors = [c + draw.normal(size=16) * 0.1 for c in centres for _ in range(40)] + [draw.normal(size=16) for _ in range(60)]
    rows = [(i, [float(x) for x in v], int(draw.integers(0, 2))) for i, v in enumerate(vectors)]
    rows += [(900, rows[0][1], rows[0][2]), (901, [2 * x for x in rows[0][1]], rows[0][2]), (902, None, 0), (903, [0.0] * 16, 0), (904, [float("nan")] + [1.0] * 15, 0), (905, [None] + [1.0] * 15, 0), (906, rows[0][1], None), (907, [1.0] * 3, 0), (908, [1.0] * 3, 0), (909, [], 0), (None, [5.0] * 3, 1)]
    table = spark.createDataFrame([(*r, "extra", 3) for r in rows], "vec_id long, embedding array<double>, label int, digest string, node int")
    found = {r["vec_id"]: r for r in pq.near_duplicates(table, block=16).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, l in rows if i is not None and l is not None and i not in (902, 903, 904, 905, 909)}
    label = {i: l for i, _, l in rows}
    links = defaultdict(set)
    for a in unit:
        for b in unit:
            if a != b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= pq.COSINE:
                links[a].add(b)
    forest = components.Forest()
    forest.link((a, b) for a in links for b in links[a])
    assert len(found) == len(rows) and sum(map(len, links.values())) > 500
    for i, r in found.items():
        if i is not None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (len(links[i]), forest.root(i), forest.root(i) == i)
    assert found[None]["n_links"] == 0
    assert pq.near_duplicates(table.limit(0)).count() == 0


def planted_vectors(seed, sizes, copies, width=24):
    """Vectors about a few directions, one for each of `sizes`, and near copies of some, so that links cross lists."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(len(sizes), width))
    base = np.concatenate([c + draw.normal(size=(n, width)) * 0.6 for c, n in zip(centres, sizes)])
    near = base[draw.integers(0, len(base), copies)]
    return np.concatenate([base, near + draw.normal(size=near.shape) * draw.uniform(0.02, 0.25, (copies, 1))])


def links_of(x):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero(unit @ unit.T >= pq.COSINE)
    return {(i, j) for i, j in zip(a.tolist(), b.tolist()) if i != j}


@pytest.mark.parametrize("block", [97, 1000, 8192])
def test_near_vectors_across_lists(spark, block):
    """Several lists and guests in them, with cells on either side of a chunk's border, lose no link."""
    x = planted_vectors(block, [255, 256, 257, 600, 40, 900, 1], 900)
    table = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    links = links_of(x)
    n = np.bincount([a for a, _ in links], minlength=len(x))
    forest = components.Forest()
    forest.link(links)
    found = pq.near_duplicates(table, block=block, list_rows=300).collect()
    assert len(found) == len(x) and len(links) > 800
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in found} == {(i, int(n[i]), forest.root(i)) for i in range(len(x))}


@pytest.mark.parametrize("held", [1, 2, 255, 256, 257, 300, 513])
def test_guests_meet_all_home_rows(spark, held):
    """A label whose home rows are all in one list and whose copies are guests of it, with any number of home rows."""
    draw = np.random.default_rng(held)
    home, away = np.zeros(16), np.zeros(16)
    home[0], away[:2] = 1.0, (np.cos(0.38), np.sin(0.38))
    tilt = lambda c, n: c + draw.normal(size=(n, 16)) * 0.01
    between = np.zeros(16)
    between[:2] = np.cos(0.19), np.sin(0.19)
    x = np.concatenate([tilt(home, held), tilt(away, 300), tilt(between, 40)])
    table = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    n = np.bincount([a for a, _ in links_of(x)], minlength=len(x))
    found = {r["vec_id"]: r["n_links"] for r in pq.near_duplicates(table, list_rows=(len(x) + 1) // 2).collect()}
    assert [found[i] for i in range(len(x))] == n.tolist()


def test_probes_miss_nothing():
    draw = np.random.default_rng(8)
    x = draw.normal(size=(800, 12))
    x[400:] = x[:400] + draw.normal(size=(400, 12)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    model = pq.Quantiser(x[::7], 24)
    home, codes, missed = model.place(x)
    asked = set(zip(*(a.tolist() for a in model.probes(x, home, 0.2))))
    a, b = np.nonzero(np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.2)
    assert all((i, home[j]) in asked for i, j in zip(a.tolist(), b.tolist()) if home[j] > home[i])
    for i, j in zip(a.tolist(), b.tolist()):
        reach = np.array([0.2 + missed[j] + 1e-6])
        assert model.near(x[i : i + 1], home[j], codes[j : j + 1].astype(np.intp), reach)[0, 0]


# Quality and toxicity


def plain_tokens(text):
    """Runs of letters, digits and non-ASCII characters, and runs of other visible ones."""
    return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^\s0-9A-Za-z\u0080-\U0010ffff]+", text or "")


def plain_buckets(text):
    """Bucket of every unigram and bigram, token by token; only the hash of a single token is shared."""
    hashes = [int(tokens.token_hashes([t], lower=False, punctuation=True)[0][0]) for t in plain_tokens(text)]
    pairs = [int(quality._TWICE) if a == b else int(tokens.mix(np.array([(a * 3 + b) % 2**64], np.uint64))[0]) for a, b in zip(hashes, hashes[1:])]
    return [h % quality.BUCKETS for h in hashes + pairs]


def test_quality_by_brute_force(spark):
    draw = random.Random(6)
    good = [" ".join(draw.choice(["sun", "tree", "river", "walks", "quiet", "old"]) for _ in range(draw.randrange(5, 60))) for _ in range(80)]
    bad = [" ".join(draw.choice(["sun&&&", "$$$", "WIN!!", "tree%%", "sun"]) for _ in range(40)) for _ in range(40)]
    texts = [*good, *bad, "", None, "a a a", LONG[:5000]]
    docs = make(spark, texts).withColumn("w", F.lit("own")).withColumn("kept", F.lit("own")).withColumn("row", F.lit("own"))
    marks = {i: int(i < 80) for i in range(0, 120, 2)}
    labels = spark.createDataFrame([*marks.items(), (None, 1), (5, None)], "doc_id long, quality int")
    counts = [Counter(plain_buckets(t)) for t in texts]
    raw, target = sum(counts, Counter()), sum((c for i, c in enumerate(counts) if marks.get(i) == 1), Counter())
    n_raw, n_target = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    ratio = lambda b: math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw)
    weight = [sum(ratio(b) * k for b, k in c.items()) / (sum(c.values()) + quality.SHRINK) for c in counts]
    noise = {r["doc_id"]: r["g"] for r in docs.select("doc_id", quality.gumbel(11, "doc_id", "text").alias("g")).collect()}
    key = {i: quality.SCALE * w + noise[i] for i, w in enumerate(weight)}
    marked = sorted((weight[i], m) for i, m in marks.items())
    cuts = {w: sum(m == 1 and x >= w for x, m in marked) / 40 - sum(m == 0 and x >= w for x, m in marked) / 20 for w, _ in marked}
    best = min(w for w, v in cuts.items() if v == max(cuts.values()))
    floor = (best + max((w for w, _ in marked if w < best), default=best)) / 2
    for k in (None, 1, 50):
        found = quality.resample(docs, labels, keep=docs.columns, k=k).select("row.doc_id", "row.w", "row.row", "log_weight", "gumbel_key", F.col("kept").alias("stays"))
        wanted = k or sum(w >= floor for w in weight)
        stay = set(sorted(key, key=key.get, reverse=True)[:wanted])
        rows = found.collect()
        assert len(rows) == len(texts) and {r["doc_id"] for r in rows if r["stays"]} == stay
        for r in rows:
            assert r["w"] == r["row"] == "own"
            assert r["log_weight"] == pytest.approx(weight[r["doc_id"]], abs=1e-9) and r["gumbel_key"] == pytest.approx(key[r["doc_id"]], abs=1e-6)
    assert len(stay - set(range(80))) <= 4  # only the odd texts, whose weight is near 0
    assert quality.resample(docs.limit(0), labels).count() == 0
    assert quality.resample(docs, labels.limit(0)).where("kept").count() == quality.resample(docs, labels.where("quality = 1")).where("kept").count() == len(texts)


def test_draws_follow_weights(spark):
    """Over 2,000 seeds, how often a document is among the k largest keys is what drawing one after the other by weight gives."""
    weights = np.array([0.0, 0.5, 1.0, 1.5, 2.0, 3.0])
    p = np.exp(weights) / np.exp(weights).sum()
    first = p
    two = np.array([p[i] + sum(p[j] * p[i] / (1 - p[j]) for j in range(6) if j != i) for i in range(6)])
    rows = spark.range(2000).withColumnRenamed("id", "seed").crossJoin(spark.createDataFrame(list(enumerate(weights.tolist())), "doc_id int, w double"))
    keyed = rows.withColumn("v", F.col("w") + quality.gumbel(F.col("seed"), "doc_id"))
    best = keyed.groupBy("seed").agg(F.slice(F.sort_array(F.collect_list(F.struct("v", "doc_id")), asc=False), 1, 2).alias("best")).collect()
    for k, wanted in ((1, first), (2, two)):
        seen = np.bincount([e["doc_id"] for r in best for e in r["best"][:k]], minlength=6) / 2000
        assert np.abs(seen - wanted).max() < 4 * np.sqrt(0.25 / 2000)


def test_noise_decides_a_draw(spark):
    """Of a half of equally good documents most are drawn by noise, other ones with another seed; none of the bad."""
    draw = random.Random(8)
    words = [f"sun{i}" for i in range(40)]
    texts = [" ".join(draw.choices(words, k=80)) for _ in range(200)] + [" ".join(draw.choices(["$$$", "WIN!!", "%%"], k=80)) for _ in range(60)]
    docs, labels = make(spark, texts), spark.createDataFrame([(i, int(i < 200)) for i in range(0, 260, 3)], "doc_id long, quality int")
    drawn = []
    for seed in (1, 2):
        found = {r["doc_id"]: r for r in quality.resample(docs, labels, seed=seed).select("row.doc_id", "log_weight", "kept", "sampled").collect()}
        assert {i for i, r in found.items() if r["kept"]} == set(range(200))
        drawn.append({i for i, r in found.items() if r["sampled"]})
        heaviest = sorted(range(200), key=lambda i: -found[i]["log_weight"])[:100]
        assert len(drawn[-1]) == 100 and len(drawn[-1] - set(heaviest)) > 5
    assert len(drawn[0] - drawn[1]) > 5


def binned(good, bad):
    values = sorted({*good, *bad})
    return [np.array(x, float) for x in (values, values, [good.count(v) for v in values], [bad.count(v) for v in values])]


def test_best_cut():
    assert quality.best_cut(*binned([1.0, 2.0], [-2.0, -1.0])) == 0.0
    assert quality.best_cut(*binned([1.0, -3.0, 2.0], [-2.0, 0.0])) == 0.5
    assert quality.best_cut(*binned([], [1.0])) == quality.best_cut(*binned([1.0], [])) == float("-inf")


def test_every_label_sets_the_floor(spark):
    """60,000 documents of either mark; the bad ones, and later one good one, are enough to place the cut."""
    weights = spark.range(120_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, F.col("id") % 8 - 4).otherwise(F.lit(-9)).cast("double").alias("w"))
    labels = weights.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    assert quality.label_floor(weights, labels) == -6.0  # between -9 and the least good weight, -3
    one = labels.where("doc_id = 1").unionByName(labels.where("quality = 0"))
    assert quality.label_floor(weights, one) == -6.0 and quality.label_floor(weights, one.where("quality = 1")) == float("-inf")


def test_kth_largest(spark):
    draw = random.Random(9)
    values = [draw.choice([draw.gauss(0, 1), 3.0, -1e9, 1e-300]) for _ in range(3000)]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 700, 2999, 3000, 9000):
        assert quality.kth_largest(table, k, bins=8, few=5) == sorted(values, reverse=True)[min(k, 3000) - 1]


def test_toxicity_on_held_out_texts(spark):
    draw = random.Random(7)
    words = [f"w{draw.randrange(400)}" for _ in range(400)]
    clean = [" ".join(draw.choices(words, k=draw.randrange(5, 200))) for _ in range(600)]
    toxic = [" ".join([*draw.choices(words, k=80), *draw.choices(["vile", "scumbag", "hateful"], k=draw.randrange(1, 9))]) for _ in range(200)]
    docs = make(spark, [*clean, *toxic, "", None, LONG])
    labels = spark.createDataFrame([(i, int(i >= 600)) for i in range(0, 800, 2)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    found = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.severity(model, F.col("text")).alias("s")).collect()}
    wrong = [i for i in range(1, 800, 2) if (found[i] >= toxicity.REJECT_FROM) != (i >= 600)]
    assert len(wrong) <= 4 and max(found[800], found[801], found[802]) < toxicity.REJECT_FROM
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert docs.limit(0).where(toxicity.severity(None, F.col("text")) < 1).count() == 0


def test_severity_follows_planted_density(spark):
    """Held-out texts with more of the toxic vocabulary are the more severe; how much of it stands in a text is planted."""
    draw = random.Random(21)
    ordinary, vile = [f"w{i}" for i in range(500)], [f"v{i}" for i in range(30)]
    planted = [0] * 500 + [draw.randrange(1, 25) for _ in range(300)]
    texts = [" ".join(draw.sample([*draw.choices(ordinary, k=60), *draw.sample(vile, n)], 60 + n)) for n in planted]
    labels = spark.createDataFrame([(i, int(n > 0)) for i, n in enumerate(planted) if i % 2], "doc_id long, toxic int")
    docs = make(spark, texts)
    model = toxicity.train(docs, labels)
    found = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.severity(model, F.col("text")).alias("s")).collect()}
    away = [(planted[i], found[i]) for i in range(0, 800, 2)]
    mean = lambda lo, hi: np.mean([s for n, s in away if lo <= n < hi])
    assert mean(0, 1) < 0.1 < mean(1, 6) < mean(6, 12) < mean(12, 18) <= mean(18, 25)
    toxic = [(n, s) for n, s in away if n]
    rank = lambda values: np.argsort(np.argsort(values, kind="stable"), kind="stable")
    assert np.corrcoef(rank([n for n, _ in toxic]), rank([s for _, s in toxic]))[0, 1] > 0.85


def test_severity_by_loops():
    """Grades, likelihood and expected severity recomputed text by text; no step of the fit makes the likelihood better."""
    draw = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)]
    vile = [f"v{i}" for i in range(20)]
    texts = [" ".join(draw.choices(vocabulary, k=30)) for _ in range(300)] + [" ".join(draw.choices(vocabulary, k=20) + draw.sample(vile, draw.randrange(1, 18))) for _ in range(150)]
    toxic = np.array([0] * 300 + [1] * 150)
    slots, owner = toxicity.features(texts)
    have = [set(slots[owner == i].tolist()) for i in range(len(texts))]
    gain = lambda k, n, big_k, big_n: sum(x * math.log(x / e) for x, e in ((k, (k + n) * big_k / (big_k + big_n)), (n, (k + n) * big_n / (big_k + big_n)), (big_k - k, (big_k + big_n - k - n) * big_k / (big_k + big_n)), (big_n - n, (big_k + big_n - k - n) * big_n / (big_k + big_n))) if x > 0) * 2
    fold = np.arange(len(texts)) % 3
    grades = []
    for h, t, k in zip(have, toxic, fold):
        high, low = (Counter(f for i, o in enumerate(have) if toxic[i] == mark and fold[i] != k for f in o) for mark in (1, 0))
        markers = {f for f in high if math.log((high[f] + 0.5) / 101) - math.log((low[f] + 0.5) / 201) > 2 and gain(high[f], low[f], 100, 200) >= 12 and high[f] * 200 > low[f] * 100} if t else set()
        grades.append(0 if not t else 1 + (len(h & markers) >= 6) + (len(h & markers) >= 12))
    assert toxicity.severity_grades(slots, owner, toxic, fold).tolist() == grades and set(grades) == {0, 1, 2, 3}
    assert set(toxicity.severity_grades(slots, owner, toxic, np.zeros(len(texts), int)).tolist()) == {0, 1}  # no other fold
    model = toxicity.fit_ordinal(slots, owner, np.array(grades), l1=0.0)
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def loss(weights, theta):
        out = 0.0
        for h, g in zip(have, grades):
            score = sum(weights[f] for f in h)
            edges = [1.0, *(sigmoid(score - t) for t in theta), 0.0]
            out -= math.log(max(edges[g] - edges[g + 1], 1e-12))
        return out / len(grades)

    weights = {f: float(model.weights[f]) for h in have for f in h}
    fitted = loss(weights, model.thresholds)
    assert min(weights.values()) >= 0 and fitted < 0.9 * loss(dict.fromkeys(weights, 0.0), [math.log(300 / 150), math.log(400 / 50), math.log(440 / 10)])
    for shift in (-0.1, 0.1):
        assert loss(weights, model.thresholds + shift) > fitted - 1e-3
        assert loss({f: max(0.0, w + shift * (w > 0)) for f, w in weights.items()}, model.thresholds) > fitted - 1e-3
    want = [sum(sigmoid(sum(weights[f] for f in h) - t) for t in model.thresholds) for h in have]
    assert np.allclose(toxicity.score_texts(model, texts), want, atol=1e-4)


def test_toxicity_fits_texts_that_share_an_id(spark):
    """Which of the texts of one doc_id is picked is settled by their hashes, not by the order of rows."""
    texts = ["plain words here"] * 3 + [f"vile filth {i}" for i in range(40)] + [f"sunny day {i}" for i in range(40)]
    ids = [0, 0, 0] + [i // 2 for i in range(80)]
    docs = make(spark, texts, ids=ids)
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, toxic int")
    first, second = (toxicity.train(docs.repartition(n).orderBy(F.rand(n)), labels) for n in (1, 7))
    assert np.array_equal(first.weights, second.weights) and np.array_equal(first.thresholds, second.thresholds)
    shared = toxicity.score_texts(first, ["vile filth 3", "sunny day 3"])
    assert shared[0] > shared[1]


# Jaccard join


def test_join_by_brute_force(spark):
    draw = random.Random(10)
    base = [" ".join(f"w{draw.randrange(5000)}" for _ in range(120)) for _ in range(12)]
    texts = list(ODD)
    for text in base:
        texts.append(text)
        for _ in range(12):
            words = text.split()
            for _ in range(draw.randrange(4)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += [base[0], base[0].upper() + "!"]
    sets = dict(enumerate(jaccard.shingle_sets(texts)))
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            if a != b and len(sets[a]) and len(sets[b]):
                shared = len(np.intersect1d(sets[a], sets[b]))
                if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                    links[a].add(b)
    forest = components.Forest()
    forest.link((a, b) for a in links for b in links[a])
    found = jaccard.join(make(spark, texts)).collect()
    assert len(found) == len(texts)
    for r in found:
        i = r["doc_id"]
        assert (r["class_id"], r["n_links"], r["is_representative"]) == (forest.root(i), len(links[i]), forest.root(i) == i)


def test_join_in_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "gridded", lambda rows, key, by, block=4: gridded(rows, key, by, 4))
    from loomtext.llm.runs import gridded

    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words[:i], f"y{i}", *words[i + 1 :]]) for i in range(30)]
    for small in (64, 1):
        monkeypatch.setattr(jaccard, "SMALL", small)
        found = jaccard.join(make(spark, texts)).collect()
        assert {r["class_id"] for r in found} == {0} and {r["n_links"] for r in found} == {29}
    repeated = jaccard.join(make(spark, [texts[0], texts[0], texts[1], None, ""], ids=[1, 1, None, None, 4])).collect()
    assert sorted(r["n_links"] for r in repeated) == [0, 0, 2, 2, 2]
    assert jaccard.join(make(spark, [])).count() == 0


def test_tries_join_what_all_pairs_would():
    rng = np.random.default_rng(4)
    depth, shortest, least = 8, 5, 0.64
    for kinds in (1, 3, 40):
        base = rng.integers(0, 1 << 16, (kinds, 20 * depth)).astype(np.uint16)
        signs = base[rng.integers(0, kinds, 150)]
        signs = np.where(rng.random(signs.shape) < rng.choice([0.02, 0.2, 0.4], (150, 1)), rng.integers(0, 1 << 16, signs.shape), signs).astype(np.uint16)
        signs[:, :shortest] = 7  # one subtree of the first trie
        signs[:, shortest:depth] = rng.integers(0, 2, (150, depth - shortest))
        signs = signs[np.lexsort(signs[:, :depth].T[::-1])]
        own = rng.integers(0, 2, 150)
        for wanted in (lambda i, rest: np.ones(len(rest), bool), lambda i, rest: own[rest] != own[i]):
            tries, brute = components.Forest(), components.Forest()
            tries.link(jaccard.trie_edges(signs, signs[:, :depth], wanted, shortest, least))
            brute.link((i, j) for i in range(150) for j in range(i + 1, 150) if wanted(i, np.array([j]))[0] and (signs[i] == signs[j]).mean() >= least)
            assert [tries.root(i) for i in range(150)] == [brute.root(i) for i in range(150)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, j) for j in range(1001, 1400)]
    random.Random(1).shuffle(edges)
    table = spark.createDataFrame(edges, "a long, b long").repartition(9)
    found = {r["node"]: r["root"] for r in components.components(table).collect()}
    assert {found[i] for i in range(301)} == {0} and {found[i] for i in range(1000, 1400)} == {1000}
    assert components.components(table.limit(0)).count() == 0


def test_prefixes_shorten_to_the_recall():
    depth = jaccard.matched_depth(0.8, jaccard.TREES, jaccard.DEPTH, jaccard.RECALL)
    recall = lambda d: 1 - (1 - 0.8**d) ** jaccard.TREES
    assert recall(depth) >= jaccard.RECALL > recall(depth + 1)


# WARC


@pytest.mark.parametrize("limit", [200_000, 0])
def test_warc(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(warc, "matched", functools.partial(matched, limit=limit))
    html = ["x" * 200, "x" * 200, "x" * 200, "short", "short", "", None, "é" * 60 + "\r\n\r\nWARC/1.1\r\n", LONG]
    pages = spark.createDataFrame([(i, f"http://a/{i} b\r\nc" if i and i % 2 else None, h, "d", 1) for i, h in zip([5, 3, 9, 1, 2, 4, 6, 7, None], html)], "page_id long, url string, html string, digest string, first int")
    found = {r["page_id"]: r for r in warc.roundtrip(pages, f"file://{tmp_path}/w").collect()}
    assert len(found) == 9
    for i, h in zip([5, 3, 9, 1, 2, 4, 6, 7, None], html):
        raw = (h or "").encode()
        assert (found[i]["payload_bytes"], found[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (found[i]["record_type"], found[i]["refers_to"]) == (("revisit", 3) if i in (5, 9) else ("response", None))
        if i not in (5, 9):
            assert bytes(found[i]["payload"]) == raw
    # Every member of a normalised file is one record, at the place that the index gives.
    for path in (tmp_path / "w/records").glob("*.warc.gz"):
        data = path.read_bytes()
        for line in Path(f"{path}.idx").read_text().splitlines():
            offset, length, urn = line.split(" ", 2)
            assert f"WARC-Record-ID: {urn}".encode() in gzip.decompress(data[int(offset) : int(offset) + int(length)])
    mono = next((tmp_path / "w/monolithic").glob("*.warc.gz")).read_bytes()
    stream = zlib.decompressobj(31)
    stream.decompress(mono)
    assert stream.eof and not stream.unused_data  # one gzip stream over the whole file
    assert warc.roundtrip(pages.limit(0)).count() == 0


def test_truncated_archive_raises():
    whole = warc.record(1, None, b"abc", "d", None)
    with pytest.raises(ValueError):
        list(warc.records_of(iter([whole[:-3]])))
    assert len(list(warc.records_of(whole[i : i + 1] for i in range(len(whole))))) == 1


# Samples


def test_least_hashed(spark):
    rows = spark.range(5000)
    h = F.xxhash64("id")
    assert {r["id"] for r in sampling.least_hashed(rows, h, 40).collect()} == {r["id"] for r in rows.orderBy(h).limit(40).collect()}
    same = rows.select(F.lit(1).alias("x"))
    assert sampling.least_hashed(same, F.xxhash64("x"), 10).count() == 10
    assert int(small_batches(spark).conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
