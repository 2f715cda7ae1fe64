"""The registered queries of the thirteen operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe_codec, conversations, fingerprint, jaccard, language, mixing, negatives, pq, quality, sharding, token_count, toxicity, warc
from loomtext.session import small_batches, spread

TOKEN_LIMIT = 512


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return rows if name == "labels" else spread(rows)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    mixed = mixing.replicate(docs, mixing.rates(docs))
    return mixed.select("doc_id", "source", "lang", "n_chars", "text", F.round("mix_rate", 6).alias("rate"), F.col("mix_copies").alias("copies"), F.col("mix_copy").alias("copy"), F.col("mix_key").alias("shuffle_key"))


OP3_SQL = f"""
WITH sizes AS (SELECT coalesce(source, '') AS s, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY 1),
rates AS (SELECT s, round(pow(size, {mixing.EXPONENT}) / (SELECT sum(pow(size, {mixing.EXPONENT})) FROM sizes) * (SELECT sum(size) FROM sizes) / size, 9) AS rate FROM sizes),
drawn AS (SELECT d.*, r.rate, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / pow(16, 13) AS u
  FROM documents d JOIN rates r ON coalesce(d.source, '') = r.s),
steps AS (SELECT s, n, sum(exp(n * ln(rate) - rate - lgamma(n + 1))) OVER (PARTITION BY s ORDER BY n) AS below FROM rates, range(0, (SELECT (max(rate) + 40 * sqrt(max(rate)) + 41)::BIGINT FROM rates)) t(n) WHERE rate > 0 AND n <= rate + 40 * sqrt(rate) + 40),
counted AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, d.rate, (SELECT count(*) FROM steps p WHERE p.s = coalesce(d.source, '') AND p.below <= d.u AND p.below < 1 - 1e-13)::INT AS copies FROM drawn d)
SELECT doc_id, source, lang, n_chars, text, round(rate, 6) AS rate, copies, copy::INT AS copy, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)
"""


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    vocabulary = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text("utf-8")
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_count.token_count(docs, F.col("text"), vocabulary).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(_table(spark, sf_dir, "embeddings"))


OP5_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
able AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {pq.COSINE}),
reach AS (SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id)::BIGINT AS n_links, least(v.vec_id, coalesce((SELECT min(other) FROM reach r WHERE r.vec_id = v.vec_id), v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce((SELECT min(other) FROM reach r WHERE r.vec_id = v.vec_id), v.vec_id)) AS kept
FROM v
"""


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.resample(docs, _table(spark, sf_dir, "labels")).select("row.doc_id", "log_weight", "gumbel_key", "kept", "sampled")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.severity(model, F.col("text")).alias("severity"))
    return scored.withColumn("toxic", F.col("severity") >= toxicity.REJECT_FROM)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", F.col("is_representative").alias("kept"))


OP8_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE text IS NOT NULL),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {jaccard.WORDS - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {jaccard.WORDS - 1}) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE shared.n >= {jaccard.THRESHOLD} * (x.n + y.n - shared.n) - 1e-9),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least_of AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1),
degree AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY 1)
SELECT d.doc_id, least(d.doc_id, coalesce(m, d.doc_id)) AS class_id, coalesce(g.n, 0)::BIGINT AS n_links, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN least_of USING (doc_id) LEFT JOIN degree g USING (doc_id)
"""


def byte_bpe(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> bpe_codec.ByteBPE:
    return bpe_codec.ByteBPE(spark, Path(public_tokenizers.path(name)).read_bytes(), public_tokenizers.PATTERN)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = byte_bpe(spark)
    both = _table(spark, sf_dir, "documents").select("doc_id", codec.round_trip(F.col("text")).alias("both"))
    return both.select("doc_id", F.size("both.ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("both.ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("both.decoded", 256).alias("decoded_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN strlen(h) >= {warc.MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM d
"""


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language.held_out().alias("held_out"))
    model = language.train(docs.where("doc_id IS NOT NULL AND NOT held_out"), Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes())
    found = docs.select("doc_id", "held_out", language.predicted(model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(_table(spark, sf_dir, "conversations"))
    found = conversations.summaries(rows, conversations.edits(rows))
    return found.withColumn("conv_id", F.col("conv_id").cast("long"))


#: One recursion step for each row: t holds the cheapest (cost, audit) of each state, the initial of the last turn that stays.
OP12_SQL = f"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
bits AS (SELECT n, list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS v FROM (SELECT unnest(range(0, 256))::BIGINT AS n)),
crc AS (SELECT list(v ORDER BY n) AS table_ FROM bits),
h AS (SELECT o.*, xor(list_reduce(list_transform(regexp_extract_all(k, '.'), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, table_[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind FROM o, crc),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) r(copy)),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen FROM e),
g AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN seen = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM f),
x AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM g),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank')::BIGINT AS blank, count(*) FILTER (fault = 'duplicate')::BIGINT AS duplicate, count(*) FILTER (fault = 'truncated')::BIGINT AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM x GROUP BY conv_id),
t(conv_id, i, state, cost, audit) AS (SELECT conv_id, 0::BIGINT, '', 0::BIGINT, '' FROM counts
  UNION ALL SELECT conv_id, i, state, min((cost, audit))[1], min((cost, audit))[2] FROM (
    SELECT t.conv_id, t.i + 1 AS i, e.state, t.cost + e.cost AS cost, t.audit || e.letters AS audit FROM t JOIN g ON g.conv_id IS NOT DISTINCT FROM t.conv_id AND g.i = t.i + 1,
    LATERAL (SELECT t.state AS state, {conversations.DELETE} AS cost, 'D' AS letters
      UNION ALL SELECT 's', CASE WHEN g.fault = 'truncated' THEN {conversations.BROKEN} ELSE 0 END, 'K' WHERE g.initial = 's' AND t.state = '' AND coalesce(g.fault, '') NOT IN ('blank', 'duplicate')
      UNION ALL SELECT w, CASE WHEN g.fault = 'truncated' THEN {conversations.BROKEN} ELSE 0 END + CASE WHEN g.initial = w THEN 0 ELSE {conversations.REROLE} END + {conversations.INSERT} * ((w = 'u') = (t.state = 'u'))::INT, CASE WHEN (w = 'u') = (t.state = 'u') THEN 'I' ELSE '' END || CASE WHEN g.initial = w THEN 'K' ELSE 'R' END
        FROM (VALUES ('u'), ('a')) v(w) WHERE coalesce(g.fault, '') NOT IN ('blank', 'duplicate')) e) GROUP BY conv_id, i, state),
n AS (SELECT conv_id, max(i) AS rows FROM g GROUP BY conv_id),
best AS (SELECT t.conv_id, min((cost + {conversations.INSERT} * CASE state WHEN 's' THEN 2 WHEN 'u' THEN 1 ELSE 0 END, audit || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END)) AS b FROM t JOIN n ON n.conv_id IS NOT DISTINCT FROM t.conv_id AND n.rows = t.i GROUP BY t.conv_id),
letters AS (SELECT conv_id, b[2] AS audit, unnest(range(1, length(b[2]) + 1)) AS p FROM best),
steps AS (SELECT conv_id, p, substr(audit, p, 1) AS edit, length(replace(audit[1:p], 'I', '')) AS i, length(replace(audit[1:p], 'D', '')) AS place FROM letters),
turns AS (SELECT s.conv_id, p, place, edit, g.role, g.text, g.initial, max((place = 1 AND edit = 'K' AND initial = 's')::INT) OVER (PARTITION BY s.conv_id) AS system FROM steps s LEFT JOIN g ON s.edit <> 'I' AND g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.i = s.i WHERE edit <> 'D'),
whole AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS w FROM turns GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b[1], 0)::BIGINT AS cost, coalesce(b[2], '') AS audit, sha256(coalesce(w, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 0)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id))::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score QUALIFY rank <= 3
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_fingerprint, op2_shard, op3_mix, op4_token_count, op5_pq_near_dedup, op6_importance, op7_toxicity, op8_jaccard_join, op9_byte_bpe, op10_warc, op11_language, op12_conversations, op13_hard_negatives)}
ORACLES: dict[str, str] = {"op3_mix": OP3_SQL, "op5_pq_near_dedup": OP5_SQL, "op8_jaccard_join": OP8_SQL, "op10_warc": OP10_SQL, "op12_conversations": OP12_SQL, "op13_hard_negatives": OP13_SQL}
