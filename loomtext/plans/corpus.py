"""Queries over sources, statistics and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import kernels as K
from loomtext.operators import bpe, model, sampling
from loomtext.operators.order import with_offset, with_position
from loomtext.plans.catalog import Catalog, table
from loomtext.session import fresh_path, pinned, small_side, spread
from loomtext.sources import sinks
from loomtext.sources import text as sources

FILE_BYTES = 1 << 20
SAMPLE, SEED = 40, 42
_C = Catalog()
QUERIES, ORACLES = _C.queries, _C.oracles


@_C.add("SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''")
def nonempty_filter(spark, sf):
    return sources.non_empty(table(spark, sf, "documents")).select("doc_id", "text")


@_C.add("SELECT doc_id, lang, (dense_rank() OVER (ORDER BY lang NULLS LAST) - 1)::INT AS src_order, text || chr(10) AS line FROM documents")
def corpus_union(spark, sf):
    docs = sources.union_by_language(table(spark, sf, "documents"))
    return docs.select("doc_id", "lang", "src_order", F.concat("text", F.lit("\n")).alias("line"))


@_C.add("SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS position, doc_id, md5(text) AS digest FROM documents")
def row_by_position(spark, sf):
    return with_position(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest")), "doc_id").select("position", "doc_id", "digest")


@_C.add("SELECT lang, sum(strlen(text))::BIGINT AS bytes, sum(length(text))::BIGINT AS chars, count(*)::BIGINT AS docs FROM documents GROUP BY lang")
def byte_len_by_lang(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("docs"))


@_C.add("SELECT source, lang, count(*)::BIGINT AS docs, count(text)::BIGINT AS with_text, sum(strlen(text))::BIGINT AS bytes, max(strlen(text))::BIGINT AS longest, round(avg(length(text)), 6) AS mean_chars FROM documents GROUP BY source, lang")
def corpus_stats(spark, sf):
    size = F.octet_length("text")
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("docs"), F.count("text").alias("with_text"), F.sum(size).alias("bytes"), F.max(size).cast("long").alias("longest"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


@_C.add("SELECT ('0x' || h)::INT AS id, count(*)::BIGINT AS cnt FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) GROUP BY 1")
def byte_histogram(spark, sf):
    return bpe.byte_counts(spread(table(spark, sf, "documents")))


@_C.add("SELECT doc_id, url FROM (SELECT page_id AS doc_id, url FROM pages) WHERE NOT (suffix(url, '1') OR suffix(url, '.html'))")
def suffix_filter(spark, sf):
    ends = F.exists(F.array(F.lit("1"), F.lit(".html")), lambda s: F.endswith("url", s))
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url").where(~ends)


_WHITE = " || ".join(f"chr({ord(c)})" for c in sources.WHITE)


@_C.add(f"SELECT doc_id, md5(trim(chr(9) || chr(8195) || text || ' ' || chr(10), {_WHITE})) AS digest FROM documents")
def strip_text(spark, sf):
    padded = F.concat(F.lit("\t "), "text", F.lit(" \n"))
    return table(spark, sf, "documents").select("doc_id", F.md5(sources.strip(padded)).alias("digest"))


@_C.add(f"SELECT file, count(*)::BIGINT AS docs, sum(strlen(text))::BIGINT AS bytes, md5(string_agg(text, '' ORDER BY doc_id)) AS digest FROM (SELECT doc_id, text, ((sum(strlen(text)) OVER (ORDER BY doc_id) - strlen(text)) // {FILE_BYTES})::INT AS file FROM documents) GROUP BY file")
def whole_file(spark, sf):
    """All texts written as whole files, read back whole, not stripped; a file takes the documents, in order, that
    begin in a stretch of FILE_BYTES of the corpus."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    starts = with_offset(docs.select("doc_id", F.octet_length("text").alias("n")), "doc_id", F.coalesce("n", F.lit(0)).cast("long"))
    places = starts.select("doc_id", F.floor(F.col("offset") / FILE_BYTES).cast("int").alias("file"))
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    whole = docs.join(small_side(places), "doc_id").groupBy("file").agg(F.count("*").alias("docs"), F.array_join(F.transform(ordered, lambda e: e["text"]), "").alias("value"))
    path = fresh_path(spark, "whole")
    whole.write.partitionBy("file", "docs").option("lineSep", "\u0001").text(path)  # a mark after each text
    found = sources.read_text(spark, path, stripped=False, keep=["file", "docs"]).withColumn("text", F.expr("left(text, length(text) - 1)"))
    return found.select("file", F.col("docs").cast("long").alias("docs"), F.octet_length("text").cast("long").alias("bytes"), F.md5("text").alias("digest"))


@_C.add(f"SELECT doc_id, lang, sample_rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('{SEED}:' || doc_id), doc_id)::INT AS sample_rank FROM documents) WHERE sample_rank <= {SAMPLE}")
def sample_n_per_lang(spark, sf):
    return sampling.sample_per_group(table(spark, sf, "documents").select("doc_id", "lang"), SAMPLE, seed=SEED).select("doc_id", "lang", "sample_rank")


@_C.add(f"SELECT lang, {SAMPLE} AS wanted, count(*)::BIGINT AS found, greatest({SAMPLE} - count(*), 0)::BIGINT AS shortfall FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= {SAMPLE} GROUP BY lang")
def sample_written(spark, sf):
    """The sample written once under its own path, and again without effect; then read back."""
    docs = sampling.sample_per_group(table(spark, sf, "documents"), SAMPLE, seed=SEED).select("doc_id", "lang", "text")
    folder = fresh_path(spark, "samples")
    for _ in range(2):
        path = sinks.write_corpus(docs, folder, seed=SEED, n=SAMPLE, source="documents")
    found = spark.read.parquet(path).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("found"))
    return found.select("lang", F.lit(SAMPLE).alias("wanted"), "found", F.greatest(F.lit(SAMPLE) - F.col("found"), F.lit(0)).cast("long").alias("shortfall"))


@_C.add("SELECT item_id, seq::INT AS seq, text FROM benchmark, range(1, 6) t(seq)")
def prompt_repeat(spark, sf):
    return sampling.repeat(table(spark, sf, "benchmark"), 5).select("item_id", "seq", "text")


_EXP = "list_transform(embedding, lambda x: exp(x::DOUBLE))"


@_C.add(f"""WITH w AS (SELECT vec_id, {_EXP} AS p, ('0x' || substr(md5('{SEED}:' || vec_id), 1, 13))::BIGINT / pow(16, 13) AS u FROM embeddings),
 c AS (SELECT vec_id, u, p, list_transform(range(1, len(p) + 1), lambda i: list_sum(p[1:i])) AS s FROM w)
 SELECT vec_id, len(list_filter(s, lambda v: v < u * list_sum(p)))::INT AS drawn FROM c""")
def weighted_draw(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.exp(x.cast("double"))).alias("p"), sampling.uniform(SEED, F.col("vec_id").cast("string")).alias("u"))
    return rows.select("vec_id", K.draw(F.col("p"), F.col("u")).alias("drawn"))


@_C.add("""SELECT lang, vocab_size, model, n_layer, n_head, c AS n_embd, (vocab_size * c + 1024 * c + n_layer * (12 * c * c + 13 * c) + 2 * c)::BIGINT AS parameters
 FROM (VALUES ('gpt2', 12::BIGINT, 12::BIGINT, 768::BIGINT), ('gpt2-medium', 24, 16, 1024), ('gpt2-large', 36, 20, 1280), ('gpt2-xl', 48, 25, 1600)) t(model, n_layer, n_head, c),
 (SELECT lang, count(DISTINCT w)::BIGINT AS vocab_size FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY lang UNION ALL SELECT 'published', 50257)""")
def param_counts(spark, sf):
    """Parameters of the four sizes with the published vocabulary, and with one of all words of each language."""
    words = table(spark, sf, "documents").select("lang", F.explode(F.split("text", " ")).alias("w")).distinct()
    found = words.groupBy("lang").agg(F.count("*").alias("vocab_size"))
    published = spark.range(1).select(F.lit("published").alias("lang"), F.lit(50_257).cast("long").alias("vocab_size"))
    both = pinned(found.unionByName(published), "vocabularies")
    counts = model.parameter_counts(both.select("vocab_size").distinct())
    return both.join(small_side(counts), "vocab_size").select("lang", *counts.columns)


@_C.add("""SELECT p_partkey, p_size, 1024 AS block_size FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 768 WHEN 1 THEN 1024 WHEN 2 THEN 1280 ELSE 1600 END::INT AS p_size FROM part) WHERE p_size IN (768, 1600)""")
def model_lookup(spark, sf):
    """A keyed literal lookup with a membership test and a constant column."""
    names = list(model.SIZES)
    sizes = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (i, model.SIZES[n][2])))
    rows = table(spark, sf, "part").select("p_partkey", sizes[F.col("p_size") % 4].alias("p_size"))
    return rows.where(F.col("p_size").isin(768, 1600)).withColumn("block_size", F.lit(1024))
