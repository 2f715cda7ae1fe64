"""Language identification, conversation repair and hard negatives against brute force, and their defined cases."""

import hashlib
import itertools
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

from loomtext.llm import conversations, language, negatives
from loomtext.llm.queries import QUERIES

VOCABULARY = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


# Languages


@pytest.fixture(scope="module")
def pieces():
    return language.Pieces(VOCABULARY)


def cuts(pieces, symbols):
    """All segmentations of a stretch of symbols, as lists of piece numbers."""
    number = {}
    for i, text in enumerate(pieces.texts):
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", text)
        number[(language._BYTE + int(byte[1], 16),) if byte else tuple(map(ord, text))] = i

    def go(at):
        if at == len(symbols):
            yield []
        for end in range(at + 1, len(symbols) + 1):
            if tuple(symbols[at:end]) in number:
                yield from ([number[tuple(symbols[at:end])], *rest] for rest in go(end))

    return list(go(0))


WORDS = ["the", "a", "straße", "हिन्दी", "ನಮಸ್ಕಾರ", "ߢߢ", "x\U0001d400y", "ouè", "ñandú"]


def test_forward_sums_all_segmentations(pieces):
    draw = np.random.default_rng(1)
    p = draw.random((len(pieces), 3)) ** 4
    p /= p.sum(axis=0)
    model = language.LanguageModel(pieces, ["a", "b", "c"], p)
    found = model.log_likelihood(WORDS)
    for word, row in zip(WORDS, found):
        (symbols,) = pieces.parts(word)
        ways = cuts(pieces, symbols)
        assert len(ways) > (1 if word[0] < "\u0300" else 0)
        assert row == pytest.approx([math.log(math.fsum(math.prod(p[i, k] for i in way) for way in ways)) for k in range(3)], abs=1e-9)
    long = "ab" * 100
    assert [len(s) for s in pieces.parts(long)] == [32] * 6 + [9]
    assert np.isfinite(model.log_likelihood([long, "ߢ" * 500])).all()


def test_expected_pieces_by_brute_force(pieces):
    p = language.mixed(np.random.default_rng(2).random((len(pieces), 2)))
    model = language.LanguageModel(pieces, ["a", "b"], p)
    counts, lang = np.arange(1.0, len(WORDS) + 1), np.arange(len(WORDS)) % 2
    wanted = np.zeros((len(pieces), 2))
    for word, n, k in zip(WORDS, counts, lang):
        ways = cuts(pieces, pieces.parts(word)[0])
        weights = [math.prod(p[i, k] for i in way) for way in ways]
        for way, w in zip(ways, weights):
            for i in way:
                wanted[i, k] += n * w / sum(weights)
    np.testing.assert_allclose(model.expected(WORDS, counts, lang), wanted, rtol=1e-9, atol=1e-12)


def test_held_out_languages(spark):
    """Accuracy on documents that weren't learned from, by the registered query."""
    sf = "/root/testdata/sf0.01"
    true = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_language"](spark, sf).collect()
    assert len(rows) == len(true) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    away = [r for r in rows if r["held_out"]]
    assert len(away) > 200 and sum(r["lang_pred"] == true[r["doc_id"]] for r in away) >= 0.98 * len(away)


def test_learning_rounds_raise_likelihood(spark, pieces):
    docs = spark.createDataFrame([("the other mother gathers there", "en"), ("die andere mutter sammelt dort", "de"), ("die", "de")], "text string, lang string")
    words = [(r["lang"], r["word"], r["n"]) for r in language.word_counts(docs).collect()]
    assert Counter({("de", "die"): 2, ("en", "the"): 1}).items() <= {(lang, w): n for lang, w, n in words}.items()
    fits = []
    for rounds in (1, 2, 4):
        model = language.train(docs, VOCABULARY, rounds=rounds)
        place = {name: i for i, name in enumerate(model.names)}
        values = model.log_likelihood([w for _, w, _ in words])
        fits.append(sum(n * values[i, place[lang]] for i, (lang, _, n) in enumerate(words)))
    assert fits == sorted(fits) and fits[0] < fits[-1]


def test_language_cases(spark):
    rows = [(1, "the cat and the dog", "en", 0.0), (2, "der hund und die katze", "de", 0.0), (3, None, "en", 0.0), (4, "", "fr", 0.0), (5, "12 + 3!?", "de", 0.0), (6, "THE dog", None, 0.0), (7, "x" * 100_000 + " die", None, 0.0), (9, "x" * 1_000, "de", 0.0), (None, "und", "en", 0.0), (8, "ein hund", "", 0.0), (8, "ein hund", "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").withColumn("found", F.lit("own")).withColumn("word", F.lit("own"))
    model = language.train(docs, VOCABULARY)
    assert model.names == ["", "de", "en"]  # of fr there is no word
    found = {r["doc_id"]: r["p"] for r in docs.select("doc_id", language.predicted(model, F.col("text")).alias("p")).collect()}
    assert {i for i, p in found.items() if p["lang_pred"] == "und"} == {3, 4, 5} and found[3]["score"] == 0.0
    assert found[1]["lang_pred"] == found[6]["lang_pred"] == "en" and found[2]["lang_pred"] in ("de", "") and found[8]["lang_pred"] == ""
    assert language.train(docs.limit(0), VOCABULARY) is None and language.train(docs.where("doc_id = 6"), VOCABULARY) is None
    assert {tuple(r["p"]) for r in docs.select(language.predicted(None, "text").alias("p")).collect()} == {("und", 0.0)}
    assert [r["h"] for r in docs.where("doc_id IS NULL").select(language.held_out().alias("h")).collect()] == [False]
    twin = language.LanguageModel(model.pieces, ["a", "b"], np.repeat(model.p[:-1, :1], 2, axis=1))
    assert list(language.Scorer(twin).predict(["dog"])) == [("a", 0.5)]
    small = language.Scorer(model)
    small.size = 3  # the words kept by a worker give way without changing a result
    texts = [r[1] for r in rows] * 2
    for (name, score), (wanted, p) in zip(small.predict(texts), language.Scorer(model).predict(texts), strict=True):
        assert name == wanted and score == pytest.approx(p, abs=1e-9)


# Conversations


def plain_repair(turns, insert=5):
    """The least (cost, audit) of all edits with at most two insertions in a gap."""
    best = None
    choices = [["D"] if go else [x for x in ("D", "K", "Ru", "Ra") if x != "K" or i in "sua"] for i, go, _ in turns]
    gaps = ["", "u", "a", "ua", "au"]
    for picked in itertools.product(*choices):
        base = sum({"D": 2, "K": 0}.get(c, 1) + (5 if broken and c != "D" else 0) for c, (_, _, broken) in zip(picked, turns))
        for put in itertools.product(gaps, repeat=len(turns) + 1):
            roles, audit = "", ""
            for gap, c, turn in zip(put, [*picked, None], [*turns, None]):
                roles, audit = roles + gap, audit + "I" * len(gap)
                if c:
                    roles, audit = roles + {"D": "", "K": turn[0]}.get(c, c[-1]), audit + c[0]
            if re.fullmatch(r"(s?(ua)+)?", roles):
                found = base + insert * sum(map(len, put)), audit
                best = min(best or found, found)
    return best


@pytest.mark.parametrize("insert, edits", [(5, "DKR"), (1, "DIKR")])
def test_repair_by_brute_force(insert, edits, monkeypatch):
    """At the contract's price no insertion is ever cheapest; at a lower one they are, ties included."""
    monkeypatch.setattr(conversations, "INSERT", insert)
    draw = random.Random(5)
    seen = set()
    for n in [0, 1, 2] * 25 + [3] * 40 + [4] * 6:
        turns = [(draw.choice("uuaaas t"), draw.random() < 0.2, draw.random() < 0.3) for _ in range(n)]
        turns = [(i, go, broken and not go) for i, go, broken in turns]
        wanted = plain_repair(turns, insert)
        assert conversations.audit_of(turns) == wanted
        seen |= set(wanted[1])
    assert seen == set(edits)


def expected_summary(rows):
    """The contract, conversation by conversation, in plain loops but for the programme itself."""
    out, turns_of = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if kind == 4 else " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        turns_of[conv].extend([] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1))
        out[conv] = None
    for conv in out:
        held = sorted(turns_of[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        n, seen, turns = Counter(), set(), []
        for _, role, text in held:
            visible = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
            seen.add((role, text))
            n[fault] += 1
            turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = conversations.audit_of(turns)
        numbers = [t for t, _, _ in held if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        lines, rest = [], iter(held)
        system = False
        for edit in audit:
            _, role, text = next(rest) if edit != "I" else (0, "", "")
            if edit != "D":
                system = system or (edit == "K" and not lines and role[0] == "s")
                role = role if edit == "K" else "user" if (len(lines) - system) % 2 == 0 else "assistant"
                lines.append(f"{role}:{text}")
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


ODD_TURNS = [(None, None, None, None), (None, 3, "user", "Hello."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 0, "", "b."), (1, 7, "tool", "x"), (2, 1, "user", ""), (2, 2, "assistant", " "), (2, 2, "assistant", "\t\n "), (3, 1, "system", "s."), (3, 5, "system", "s."), (4, 1, "user", "é 😀. \n"), (4, 2, "assistant", "w " * 50_000), (5, -3, "assistant", "ok!"), (5, 10**12, "user", "so?")]


@pytest.mark.parametrize("batch", [1000, 2])
def test_repair_of_odd_rows(spark, batch):
    draw = random.Random(9)
    rows = ODD_TURNS + [(c, t, draw.choice(["user", "assistant", "system", "tool"] if t == 0 else ["user", "assistant"]), draw.choice(["Yes.", "No", " ", "Why?", f"word {t}."])) for c in range(10, 50) for t in range(draw.randrange(1, 12))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    table = spark.createDataFrame([(*r, "own", 1, "x") for r in rows], "conv_id long, turn long, role string, text string, digest string, kind int, gone string")
    made = conversations.damaged(table.repartition(5))
    found = conversations.edits(made)
    wanted = expected_summary(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.summaries(made, found).collect()}
    assert got == {None if c is None else str(c): w[:-1] for c, w in wanted.items()}
    lines = defaultdict(list)
    for r in sorted(conversations.repaired(made, found).collect(), key=lambda r: r["place"]):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {k: v for k, v in lines.items() if v} == {None if c is None else str(c): w[-1] for c, w in wanted.items() if w[-1]}
    assert conversations.summaries(made.limit(0), conversations.edits(made.limit(0))).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_dropped_conversation(spark):
    gone = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    made = conversations.damaged(spark.createDataFrame([(*gone, "user", "Hi.")], "conv_id long, turn long, role string, text string"))
    assert [tuple(r) for r in conversations.summaries(made, conversations.edits(made)).collect()] == [(str(gone[0]), 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# Hard negatives


def plain_mine(rows, positives=5, negatives_=3):
    """Every score as a sum of integers; rows are (vec_id, vector, label), of which equal ones count once."""
    able = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v), label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i, v, label in able:
        if i % 50:
            continue
        scored = {(-sum(x * y for x, y in zip(v, w)), j, other == label) for j, w, other in able if j != i and len(v) == len(w)}
        for score, j, _ in sorted(s for s in scored if s[2])[:positives]:
            band = sorted(s for s in scored if not s[2] and 50 * -score <= 100 * -s[0] <= 95 * -score)[:negatives_]
            out |= {(i, j, rank, k, -score, -worse) for rank, (worse, k, _) in enumerate(band, 1)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "own", 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, v string, dim int, node int")


@pytest.mark.parametrize("width, chunk_cells", [(24, 1 << 21), (24, 200), (3, 1 << 21), (1, 64)])
def test_negatives_by_brute_force(spark, width, chunk_cells):
    draw = np.random.default_rng(width)
    stretch = np.linspace(1, 0.05, width) if width > 1 else np.ones(1)
    near = draw.normal(size=(8, width)) * stretch
    rows = [(i, [float(np.float32(x)) for x in np.round(near[i % 8] + draw.normal(size=width) * stretch * 0.5, 2)], int(i // 3 % 4)) for i in range(0, 1500, 2)]
    rows += [rows[0], (rows[25][0], rows[3][1], 2), (None, rows[0][1], 1), (50, None, 1), (100, rows[0][1], None), (150, [None] * width, 1), (200, [float("nan")] * width, 1), (250, [float("inf")] * width, 1), (300, [0.0] * width, 0), (351, [], 1), (350, [], 1), (353, [], 2), (400, [0.5] * (width + 1), 3), (407, [0.5] * (width + 1), 3), (409, [0.25] * (width + 1), 2)]
    found = [tuple(r) for r in negatives.mine(vectors(spark, rows).repartition(4), F.col("vec_id") % 50 == 0, chunk_cells=chunk_cells).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_mine(rows)
    assert len(found) > (100 if width > 1 else 30) and {(350, 351, 1, 353, 0, 0), (400, 407, 1, 409, 128 * 128 * (width + 1), 64 * 128 * (width + 1))} <= set(found)


def test_huge_components_and_empty_table(spark):
    big = float(2**40)
    rows = [(0, [big, 1.0], 1), (1, [3.0, 1.0], 1), (2, [2.0, 7.0], 2), (3, [-big, 1.0], 2), (50, [1.0, 1.0], 1)]
    found = {tuple(r) for r in negatives.mine(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()}
    assert found == plain_mine(rows) and len(found) == 1
    assert negatives.mine(vectors(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_discard_and_lose_nothing():
    draw = np.random.default_rng(4)
    x = np.floor(draw.normal(size=(600, 32)) * 256 * np.linspace(1, 0.02, 32) ** 2)
    matrix = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    q, r = (negatives.Turned([v.tobytes() for v in part], 32, matrix) for part in (x[:200], x[200:]))
    exact = x[:200] @ x[200:].T
    need, most = np.quantile(exact, 0.99, axis=1), np.quantile(exact, 0.995, axis=1)
    a, b = negatives.survivors(q, r, None, need, most)
    wanted = set(zip(*(w.tolist() for w in np.nonzero((exact >= need[:, None]) & (exact <= most[:, None])))))
    assert wanted <= set(zip(a.tolist(), b.tolist())) and len(a) < 1.5 * len(wanted) + 50
    assert (negatives.scores(q, r, a, b) == exact[a, b]).all()
