"""Writers: sampled corpora, merge tables, tokenizer bundles."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_corpus(docs: DataFrame, folder: str, *, seed: int, n: int, source: str, as_text: bool = False) -> str:
    """The path, keyed by all that made the sample; one that is there already stays as it is."""
    path = f"{folder}/{source}-seed{seed}-n{n}"
    writer = docs.write.mode("ignore")
    if as_text:
        docs.select("text").write.mode("ignore").text(path)  # a line end after each text
    else:
        writer.partitionBy("lang").parquet(path)
    return path


def merges_json(merges: DataFrame) -> DataFrame:
    """One row `json`: an object {"a,b": id} in rank order. A merge table is bounded by its vocabulary."""
    entries = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(",", "a", "b").alias("key"), "id")))
    pairs: Column = F.transform(entries, lambda e: F.struct(e["key"], e["id"]))
    return merges.agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def save_tokenizer(merges: DataFrame, vocabulary: DataFrame, folder: str, *, special: str = "<|endoftext|>") -> None:
    """merges, vocab and special tables under `folder`; BOS and EOS are the same special token, the id after the last."""
    merges.write.mode("overwrite").parquet(f"{folder}/merges")
    vocabulary.write.mode("overwrite").parquet(f"{folder}/vocab")
    last = vocabulary.agg((F.max("id") + 1).alias("id"))
    last.select(F.lit(special).alias("token"), "id", F.explode(F.array(F.lit("bos"), F.lit("eos"))).alias("role")).write.mode("overwrite").parquet(f"{folder}/special")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in tokenizer files: its own, or the next one from U+0100 on
    where that is white space, a control or the soft hyphen."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def tokenizer_json(merges: Sequence[tuple[int, int, int]], special: str) -> str:
    """A tokenizer file as the `tokenizers` library reads it: byte-level BPE of the merges (a, b, id), bytes being ids 0 to
    255, and a special token with the id after the last."""
    letters = byte_alphabet()
    words = dict(enumerate(letters))
    for a, b, new in merges:
        words[new] = words[a] + words[b]
    if len(set(words.values())) < len(words):
        raise ValueError("two ids with the same bytes can't be told apart in a tokenizer file")
    last = 256 + len(merges)
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    added = {"id": last, "content": special, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
             "vocab": {w: i for i, w in words.items()} | {special: last}, "merges": [[words[a], words[b]] for a, b, _ in merges]}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [added], "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": model}, ensure_ascii=False)


def save_bundle(spark: SparkSession, merges: Sequence[tuple[int, int, int]], folder: str, *, special: str = "<|endoftext|>") -> None:
    """A tokenizer under `folder`: its file as one text, which the `tokenizers` library opens too, and its special tokens by
    role, BOS and EOS being the same. A vocabulary is bounded, so its file is."""
    spark.createDataFrame([(tokenizer_json(merges, special),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/tokenizer.json")
    roles = [(role, special, 256 + len(merges)) for role in ("bos", "eos")]
    spark.createDataFrame(roles, "role string, token string, id int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/special")
