"""The corpus pipeline: five stages over `documents`, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. An empty table passes through as an empty one; what
the stages do with nulls, empty texts and repeated rows is said in their operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import jaccard, mixing, quality, toxicity
from loomtext.llm.queries import byte_bpe
from loomtext.session import pinned, small_batches, small_side, spread


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the rejection level."""
    model = toxicity.train(docs, small_batches(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.severity(model, docs["text"]) < toxicity.REJECT_FROM)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the largest Gumbel keys: as many as look more like those marked good than like those marked bad."""
    labels = small_batches(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.resample(docs, labels, keep=docs.columns).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id (null first), of equals the least text hash.

    Rows of equal doc_id and text, null or not, are one document, whatever other rows there are: of several, the one
    whose columns have the least hash stays.
    """
    small_batches(spark)
    found = pinned(jaccard.join(docs).select(F.col("doc_id").alias("dup_id"), F.col("text_hash").alias("dup_hash"), "is_representative"), "found")
    dropped = found.where("NOT is_representative").select("dup_id", "dup_hash").distinct().withColumn("repeats", F.lit(False))
    repeated = pinned(found.where("is_representative").groupBy("dup_id", "dup_hash").count().where("count > 1").select("dup_id", "dup_hash", F.lit(True).alias("repeats")), "repeated")
    marks = small_side(pinned(dropped.unionByName(repeated), "marks"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), F.md5(F.col("text").cast("binary")).alias("own_hash"))
    marked = rows.join(marks, F.col("own_id").eqNullSafe(F.col("dup_id")) & F.col("own_hash").eqNullSafe(F.col("dup_hash")), "left")
    kept = marked.where("repeats IS NULL").select("row")
    if not repeated.isEmpty():
        once = marked.where("repeats").groupBy("own_id", "own_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.unionByName(once.select("row"))
    return kept.select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate and dealt out anew."""
    return mixing.replicate(docs, mixing.rates(docs), added=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of the bytes that they decode to."""
    codec = byte_bpe(small_batches(spark))
    both = docs.select("doc_id", "lang", "source", codec.round_trip(docs["text"]).alias("both"))
    return both.select("doc_id", "lang", "source", "both.ids", F.size("both.ids").cast("long").alias("n_tokens"), F.sha2("both.decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", reject_toxic), ("quality", keep_quality), ("near_duplicates", drop_near_copies), ("mixing", mix_sources), ("byte_bpe", encode)]

#: Trained models, signatures and token ids are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain
#: recomputation of its decisions (with the trained model given, for the first).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
