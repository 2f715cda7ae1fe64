"""Arriving documents encoded as they come: a stateless stream, beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomtext.operators.bpe import Codec


def read_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def encode_stream(docs: DataFrame, merges: list[tuple[int, int, int]], folder: str, checkpoint: str) -> StreamingQuery:
    """Appends (doc_id, ids) for all files that are there, then stops; run again for what has come since."""
    rows = docs.select("doc_id", Codec(merges).encode("text").alias("ids"))
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
