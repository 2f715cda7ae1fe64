"""Saved tokenizers opened by the library and by our reader, and table functions against the DataFrame forms."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtext.operators import bpe, tables
from loomtext.sources import sinks
from loomtext.sources import text as sources
from tests.conftest import SF

TEXTS = ["", "a", "Hello there, hello!", "it's\n\n 12  x", "é 日本 😀 हिन्दी", "\x00\t\xad\x7f", "  <|endoftext|> "]


def test_bundle_opens_in_the_library_and_here(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    merges = bpe.train_chunks(docs, 400)
    folder = str(tmp_path / "bundle")
    for _ in range(2):  # a second save takes the place of the first
        sinks.save_bundle(spark, merges, folder)
    library = Tokenizer.from_str(sources.read_text(spark, f"{folder}/tokenizer.json", stripped=False).first()["text"])
    library.encode_special_tokens = True
    read, names, special = sources.read_tokenizer(spark, folder)
    assert [(a, b) for a, b, _ in read] == [(a, b) for a, b, _ in merges] and names == list(range(656)) and special == {"bos": 656, "eos": 656}
    assert library.token_to_id("<|endoftext|>") == 656 and library.get_vocab_size() == 657
    codec = bpe.Codec(read, names)
    both = docs.unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    rows = both.select("text", codec.encode_text("text").alias("ids")).withColumn("back", codec.decode("ids")).collect()
    for r in rows:
        assert r["ids"] == library.encode(r["text"], add_special_tokens=False).ids and r["back"] == r["text"]
        assert library.decode(r["ids"], skip_special_tokens=False) == r["text"]


def test_alphabet():
    letters = sinks.byte_alphabet()
    assert len(set(letters)) == 256 and letters[65] == "A" and letters[32] == "Ġ" and letters[10] == "Ċ" and letters[0xAD] == "Ń"
    with pytest.raises(ValueError, match="same bytes"):
        sinks.tokenizer_json([(97, 98, 256), (256, 99, 257), (98, 99, 258), (97, 258, 259)], "<s>")


def test_other_tokenizers_raise(spark, tmp_path):
    for model in ('{"model": {"type": "WordPiece", "vocab": {}}}', '{"model": {"type": "BPE", "vocab": {"a": 0}, "merges": []}}'):
        folder = str(tmp_path / str(len(model)))
        spark.createDataFrame([(model,)], "value string").write.text(f"{folder}/tokenizer.json")
        with pytest.raises(ValueError, match=folder):
            sources.read_tokenizer(spark, folder)


def test_pair_stats(spark):
    tables.register(spark)
    rows = [("x", t) for t in TEXTS] + [("y", "aaa"), (None, "ab"), ("z", None)]
    spark.createDataFrame(rows, "key string, text string").repartition(3).createOrReplaceTempView("stats_rows")
    wanted = Counter()
    for key, text in rows:
        raw = (text or "").encode()
        wanted.update((key, a, b) for a, b in zip(raw, raw[1:]))
    for tail, total in (("", "sum(cnt)"), (" PARTITION BY (key)", "max(cnt)")):
        found = spark.sql(f"SELECT key, a, b, {total} AS n FROM pair_stats(TABLE(SELECT * FROM stats_rows){tail}) GROUP BY ALL").collect()
        assert {(r["key"], r["a"], r["b"]): r["n"] for r in found} == dict(wanted)
    plain = {(r["a"], r["b"]): r["cnt"] for r in bpe.pair_counts(spark.table("stats_rows")).collect()}
    assert plain == {(r["a"], r["b"]): r["n"] for r in spark.sql("SELECT a, b, sum(cnt) AS n FROM pair_stats(TABLE(SELECT * FROM stats_rows)) GROUP BY a, b").collect()}
    with pytest.raises(Exception, match="needs a column text"):
        spark.sql("SELECT * FROM pair_stats(TABLE(SELECT key FROM stats_rows))").collect()


def test_pack_rows(spark):
    tables.register(spark)
    made = spark.createDataFrame([(k, n, [k * 1000 + n * 10 + i for i in range(n % 5)]) for k in range(3) for n in range(20)] + [(1, 50, None)], "key int, n int, ids array<int>")
    made.repartition(4).createOrReplaceTempView("pack_table")
    found = spark.sql("SELECT * FROM pack_rows(TABLE(SELECT * FROM pack_table) PARTITION BY (key) ORDER BY (n), 7)").collect()
    for k in range(3):
        flat = [k * 1000 + n * 10 + i for n in range(20) for i in range(n % 5)]
        assert sorted((r["row"], r["x"]) for r in found if r["key"] == k) == [(i, flat[7 * i : 7 * i + 7]) for i in range(len(flat) // 7)]
    with pytest.raises(Exception, match="positive constant"):
        spark.sql("SELECT * FROM pack_rows(TABLE(SELECT * FROM pack_table) PARTITION BY (key), 0)").collect()
