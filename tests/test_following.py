"""Formats by name, streams with state, and pair counts that follow a changing corpus, against plain Python."""

import base64
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtext.operators import bpe
from loomtext.operators.pair_store import PairStore, changes
from loomtext.sources import formats
from loomtext.sources import text as sources
from loomtext.streaming import pack

DOCS = "doc_id long, text string"


def brute_pairs(texts):
    found = Counter()
    for t in texts:
        raw = (t or "").encode()
        found.update(zip(raw, raw[1:]))
    return found


def counted(store):
    return {(r["a"], r["b"]): r["cnt"] for r in store.counts().collect()}


def test_counts_follow_versions(spark, tmp_path):
    versions = [
        [(1, "aaa"), (2, "abc"), (3, None), (4, ""), (5, "é日"), (None, "xx"), (7, "twice"), (7, "twice")],
        [(1, "aaab"), (2, "abc"), (3, "now"), (4, ""), (None, "xx"), (None, "xx"), (7, "twice")],
        [],
        [(9, "aaaa"), (9, "aaaa"), (9, None)],
    ]
    store, before = PairStore(spark, str(tmp_path / "pairs")), []
    assert counted(store) == {} and store.last == -1
    for number, rows in enumerate(versions):
        changed = changes(spark.createDataFrame(before, DOCS), spark.createDataFrame(rows, DOCS))
        if number == 1:
            assert sorted((str(r["text"]), r["sign"]) for r in changed.collect() if r["text"] not in ("xx", "twice")) == [("None", -1), ("aaa", -1), ("aaab", 1), ("now", 1), ("é日", -1)]
        assert store.apply(number, changed) and not store.apply(number, changed)
        assert counted(store) == brute_pairs(t for _, t in rows)
        if number % 2:
            store.fold()
            store.fold()
            assert counted(store) == brute_pairs(t for _, t in rows) and not store.apply(number, changed)
        before = rows
    assert PairStore(spark, str(tmp_path / "pairs")).last == 3


def test_counts_below_nothing_raise(spark, tmp_path):
    store = PairStore(spark, str(tmp_path))
    store.apply(0, spark.createDataFrame([("ab", 1), ("cd", -1), ("ef", None)], "text string, sign int"))
    with pytest.raises(Exception, match="more was taken away"):
        store.counts().collect()


def test_an_unfinished_change_is_not_read(spark, tmp_path):
    store = PairStore(spark, str(tmp_path))
    one = spark.createDataFrame([("ab", 1)], "text string, sign int")
    store.apply(0, one)
    store.apply(1, one)
    (tmp_path / "changes" / "1" / "_SUCCESS").unlink()
    assert store.last == 0 and counted(store) == {(97, 98): 1}
    assert store.apply(1, one) and counted(store) == {(97, 98): 2}


def test_pairs_follow_a_stream(spark, tmp_path):
    feed, store = str(tmp_path / "feed"), PairStore(spark, str(tmp_path / "pairs"))
    expected = Counter()
    for rows in ([("abab", 1), ("xyz", 1)], [("xyz", -1), ("ab", 1)], []):
        spark.createDataFrame(rows, "text string, sign int").coalesce(1).write.mode("append").parquet(feed)
        for t, sign in rows:
            for pair, n in brute_pairs([t]).items():
                expected[pair] += sign * n
        changed = spark.readStream.schema("text string, sign int").option("maxFilesPerTrigger", 1).parquet(feed)
        for _ in range(2):
            pack.follow_pairs(changed, store, str(tmp_path / "state")).awaitTermination()
        assert counted(store) == {k: n for k, n in expected.items() if n}


def test_packing_goes_on_after_a_restart(spark, tmp_path):
    feed, out, t = str(tmp_path / "feed"), str(tmp_path / "out"), 4
    schema = "lang string, doc_id long, ids array<int>"
    batches = [
        [("en", 3, [1, 2, 3]), ("en", 1, [4]), ("de", 2, [5, 6, 7, 8]), (None, 9, [1] * 9), ("en", 4, None), ("en", 5, [])],
        [("de", 1, [9]), ("en", 8, list(range(70_000))), ("en", None, [7, 7])],
        [("fr", 1, [1, 2])],
        [("en", 6, [1, 2, 3]), ("en", 6, [0]), ("fr", 0, [3, 4, 5])],
    ]
    streams = {}
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        packed = pack.pack_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed), ["lang"], t)
        pack.write_rows(packed, out, str(tmp_path / "state")).awaitTermination()  # each run begins where the last one stopped
        for lang, _, ids in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or [])):
            streams.setdefault(lang, []).extend(ids or [])
    expected = {(k, r): (ids[r * t : r * t + t], ids[r * t + 1 : r * t + t + 1]) for k, ids in streams.items() for r in range((len(ids) - 1) // t)}
    rows = spark.read.schema(packed.schema).parquet(out).collect()
    assert len(rows) == len(expected) and {(r["lang"], r["row"]): (r["x"], r["y"]) for r in rows} == expected


def test_texts_are_packed_as_their_ids(spark, tmp_path):
    feed, codec = str(tmp_path / "feed"), bpe.Codec([(97, 97, 256)])
    rows = [("en", 2, "aaab"), ("en", 1, "é"), ("en", 1, None), (None, None, "xyz"), ("en", 3, "")]
    spark.createDataFrame(rows, "lang string, doc_id long, text string").coalesce(1).write.parquet(feed)
    packed = pack.pack_stream(spark.readStream.schema("lang string, doc_id long, text string").parquet(feed), ["lang"], 2, codec)
    pack.write_rows(packed, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = {tuple(r) for r in spark.read.schema(packed.schema).parquet(str(tmp_path / "out")).selectExpr("lang", "row", "string(x)", "string(y)").collect()}
    assert found == {("en", 0, "[195, 169]", "[169, 256]"), ("en", 1, "[256, 97]", "[97, 98]"), (None, 0, "[120, 121]", "[121, 122]")}


def test_rank_files_by_format(spark, tmp_path):
    formats.register(spark)
    words = [(i, bytearray(f"word {i} é".encode() * (i % 5 + 1))) for i in range(500)] + [(500, bytearray(b"\x00\xff"))]
    folder = str(tmp_path / "ranks")
    frame = spark.createDataFrame(words, "id int, bytes binary").repartition(3)
    frame.write.format("token_ranks").mode("overwrite").save(folder)
    frame.write.format("token_ranks").mode("overwrite").save(folder)
    for split in (997, 5_000, 1 << 20):
        found = spark.read.format("token_ranks").option("split", split).load(folder)
        assert sorted((r["id"], bytes(r["bytes"])) for r in found.collect()) == [(i, bytes(w)) for i, w in words]
    assert found.count() == sources.read_ranks(spark, folder).count() == 501
    frame.limit(2).write.format("token_ranks").mode("append").save(folder)
    assert spark.read.format("token_ranks").load(folder).count() == 503
    lines = tmp_path / "lines.tiktoken"
    lines.write_bytes(b"\n" + base64.b64encode(b"ab") + b" 7\r\n\n" + base64.b64encode(b"c") + b" 8")
    for split in range(1, 9):
        assert sorted(r["id"] for r in spark.read.format("token_ranks").option("split", split).load(f"file://{lines}").collect()) == [7, 8]
    for bad in (b"YWI= 1\nYWI=\n", b"YWI= 1\n!!!! 2\n", b"YWI= 1\nYWI= x\n"):
        lines.write_bytes(bad)
        with pytest.raises(Exception, match="lines.tiktoken, byte 7"):
            spark.read.format("token_ranks").load(str(lines)).collect()
    lines.write_bytes(b"")
    assert spark.read.format("token_ranks").load(str(lines)).count() == 0
    with pytest.raises(Exception, match="missing"):
        spark.read.format("token_ranks").load(str(tmp_path / "missing")).collect()
    with pytest.raises(Exception, match="no id or no bytes"):
        spark.createDataFrame([(None, bytearray(b"x"))], "id int, bytes binary").write.format("token_ranks").mode("append").save(folder)
    assert spark.read.format("token_ranks").load(folder).count() == 503 and not list((tmp_path / "ranks").glob("_aside*"))


def test_merge_files_by_format(spark, tmp_path):
    formats.register(spark)
    merges = [(i, 97 + i, 98, 256 + i) for i in range(40)]
    folder = str(tmp_path / "merges")
    spark.createDataFrame(merges, "rank int, a int, b int, id int").repartition(2).write.format("merge_json").mode("append").save(folder)
    assert sorted(map(tuple, spark.read.format("merge_json").load(folder).collect())) == merges
    one = tmp_path / "one.json"
    one.write_text('{"97,98":256,"256,98":257}')
    found = spark.read.format("merge_json").load(str(one))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, sources.read_merges_json(spark, str(one)).collect())) == [(0, 97, 98, 256), (1, 256, 98, 257)]
    for bad, place in (('{"97,98":256,"97":257}', "entry 1"), ('{"97,98":"x"}', "entry 0"), ("[1]", "isn't an object"), ("{", "one.json")):
        one.write_text(bad)
        with pytest.raises(Exception, match=place):
            spark.read.format("merge_json").load(str(one)).collect()
