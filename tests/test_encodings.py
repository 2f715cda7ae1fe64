"""Ready-made vocabularies against the library that they are made for."""

import random

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from loomtext.operators import bpe
from loomtext.plans import registry
from loomtext.sources import text as sources
from tests.conftest import SF

ODD = ["", "a", "  two  spaces ", "it's\n\n\tdone…", "हिन्दी ಕನ್ನಡ 日本語 😀😀", "a" * 5000, "<|endoftext|>", "\x00�퟿", "x" * 70 + "=" * 200, " " * 300 + "y", "ﬁn​al nb"]


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def both(request, spark):
    path = public_tokenizers.path(request.param)
    codec = bpe.named_encoding(sources.read_ranks(spark, f"file://{path}"))
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return codec, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_ids_of_the_library_on_all_documents(spark, both):
    codec, library, _ = both
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choice("ab' \n\té日ಕ😀12.,s") for _ in range(draw.randrange(80))) for _ in range(300)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.read.parquet(f"{SF}/documents.parquet", f"{SF}/../sf0.01/documents.parquet").select("doc_id", "text"))
    for r in made.repartition(8).select("text", codec.encode_text("text").alias("ids")).withColumn("back", codec.decode("ids")).toLocalIterator():
        assert r["ids"] == library.encode_ordinary(r["text"]) and r["back"] == r["text"]


def test_recovered_merges(spark, both):
    codec, _, ranks = both
    words = set(ranks.values())
    inner = list(bpe.words_of(codec.merges).values())
    assert len(codec.merges) + 256 <= len(ranks) and all(w in ranks for w in inner)
    order = [ranks[inner[new]] for _, _, new in codec.merges]
    assert order == sorted(order) and words >= set(order)


def test_small_rank_tables(spark):
    bytes_ = [(b, bytearray([255 - b])) for b in range(256)]  # ids of bytes in another order than theirs
    table = lambda rows: spark.createDataFrame(rows, "id int, bytes binary")
    codec = bpe.named_encoding(table([*bytes_, (300, bytearray(b"ab")), (310, bytearray(b"bc")), (320, bytearray(b"abc")), (400, bytearray(b"xyz"))]))
    got = spark.createDataFrame([(t,) for t in ("abc", "bca", "xyz", "xyzz", "zz", None)], "t string").select("t", codec.encode_text("t").alias("ids"))
    assert {r["t"]: r["ids"] for r in got.collect()} == {"abc": [320], "bca": [310, 255 - 97], "xyz": [400], "xyzz": [255 - ord(c) for c in "xyzz"], "zz": [255 - 122] * 2, None: None}
    back = spark.createDataFrame([([320, 400],)], "ids array<int>").select(codec.decode("ids").alias("t"))
    assert back.first()["t"] == "abcxyz"
    with pytest.raises(Exception, match="unknown token id 301"):
        spark.createDataFrame([([301],)], "ids array<int>").select(codec.decode("ids").alias("t")).collect()
    for bad in (bytes_[1:], [*bytes_, (0, bytearray(b"ab"))], [*bytes_, (300, bytearray(b"a"))]):
        with pytest.raises(ValueError, match="rank file"):
            bpe.named_encoding(table(bad))


def test_queries(spark):
    for name in ("encode_named", "encode_named_multilingual"):
        found = registry.QUERIES[name](spark, SF)
        assert found.where("NOT whole").isEmpty() and found.agg(F.sum("n")).first()[0] > 1000


def test_pattern_is_the_published_one():
    text = "It's 12 o'clock…\n\n  हिन्दी"
    assert [m.group() for m in regex.finditer(bpe.GPT2_SPLIT, text)] == [m.group() for m in regex.finditer(public_tokenizers.PATTERN, text)]
