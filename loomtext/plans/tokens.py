"""Queries over bytes, pairs, BPE and packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from loomtext.functions import bytes as B
from loomtext.operators import bpe, packing, tables
from loomtext.operators.order import with_offset
from loomtext.operators.pair_store import PairStore, changes
from loomtext.plans.catalog import Catalog, table
from loomtext.session import ARROW_BYTES, fresh_path, pinned, small_batches, small_side, spread
from loomtext.sources import formats, sinks
from loomtext.sources import text as sources
from loomtext.streaming import encode, pack

#: How many merges the codec queries learn from the benchmark texts, and the reference sizes of the two trainers.
MERGES, STREAM_MERGES, VOCABULARY = 1_000, 7_936, 30_257
SPECIAL = "<|endoftext|>"
#: The published split pattern without its look-ahead, which DuckDB lacks: white space before a word isn't divided.
WORD_SPLIT = r" ?\p{L}+| ?\p{N}+| ?[^ \t\n\x0b\f\r\p{L}\p{N}]+|[ \t\n\x0b\f\r]+"
BATCH, LENGTH = 4, 32
_C = Catalog()
QUERIES, ORACLES = _C.queries, _C.oracles

_BYTES = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::INT)"
_STRING = f"array_to_string(list_transform({_BYTES}, lambda i: chr(i)), '')"
_IDS = "list_transform(regexp_extract_all({s}, '(?s).'), lambda c: unicode(c))"
_PAIRS = f"SELECT doc_id, i - 1 AS pos, ids[i] AS a, ids[i + 1] AS b FROM (SELECT doc_id, ids, unnest(range(1, len(ids))) AS i FROM (SELECT doc_id, {_BYTES} AS ids FROM documents))"
#: Training in SQL, a recursion step for each merge: t holds the texts after r merges, m the merges, l all of them in order.
_TRAINED = f"""WITH RECURSIVE t(r, d, s, p) AS (SELECT 0, item_id, {_STRING}, ''::VARCHAR FROM benchmark
 UNION ALL SELECT r + 1, d, replace(s, best.p, chr(256 + r)), best.p FROM t, (SELECT p FROM (SELECT d, i, substr(s, i, 2) AS p FROM (SELECT d, s, unnest(range(1, length(s))) AS i FROM t)) GROUP BY p ORDER BY count(*) DESC, min((d, i)) LIMIT 1) best WHERE r < {MERGES}),
 m AS (SELECT DISTINCT (r - 1)::INT AS rank, unicode(substr(p, 1, 1))::INT AS a, unicode(substr(p, 2, 1))::INT AS b, (255 + r)::INT AS id FROM t WHERE r > 0),
 l AS (SELECT list(chr(a) || chr(b) || chr(id) ORDER BY rank) AS ms FROM m)"""
_FOLD = "list_reduce(ms, lambda s, m: replace(s, substr(m, 1, 2), substr(m, 3, 1)), {s})"
_ENCODED = f"(SELECT doc_id, lang, text, {_FOLD.format(s=_STRING)} AS s FROM documents, l)"


def _documents(spark, sf):
    """Documents in small batches: what a Python worker holds follows a batch, not the table."""
    return spread(table(small_batches(spark, size=ARROW_BYTES), sf, "documents").select("doc_id", "text", "lang"))


def _merges(spark, sf):
    """The merges learned from the benchmark texts, all of whose pairs fit one round."""
    return bpe.train_stream(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), MERGES, hot=bpe.MAX_HOT)


def _encoded(spark, sf):
    codec = bpe.Codec(_merges(spark, sf))
    return _documents(spark, sf).withColumn("ids", codec.encode("text")), codec


@_C.add(f"SELECT a, b, count(*)::BIGINT AS cnt FROM ({_PAIRS}) GROUP BY a, b")
def byte_pair_counts(spark, sf):
    return bpe.pair_counts(_documents(spark, sf))


@_C.add(f"""SELECT a, b, count(*)::BIGINT AS cnt FROM (SELECT ids[i] AS a, ids[i + 1] AS b FROM (SELECT ids, unnest(range(1, len(ids))) AS i FROM (SELECT {_BYTES} AS ids FROM
 (SELECT text FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text) UNION ALL SELECT text FROM benchmark)))) GROUP BY a, b""")
def pair_counts_followed(spark, sf):
    """Pair counts of all documents that then follow the corpus: its repeated texts go, the benchmark's come, and each
    change reads its own texts only. One change is delivered twice."""
    docs, store = _documents(spark, sf).select("doc_id", "text"), PairStore(spark, fresh_path(spark, "pairs"))
    store.apply(0, docs.withColumn("sign", F.lit(1)))
    firsts = docs.groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    once = docs.join(small_side(pinned(firsts, "firsts")), "doc_id", "left_semi")
    changed = pinned(changes(docs, once), "changed")
    store.apply(1, changed)
    store.fold()
    store.apply(1, changed)
    store.apply(2, table(spark, sf, "benchmark").select("text", F.lit(1).alias("sign")))
    return store.counts()


@_C.add(f"SELECT doc_id, len(ids)::INT AS n, md5(array_to_string(ids, ',')) AS digest FROM (SELECT doc_id, {_BYTES} AS ids FROM documents)")
def utf8_bytes(spark, sf):
    ids = B.utf8_ids(F.col("text"))
    return _documents(spark, sf).select("doc_id", F.size(ids).alias("n"), F.md5(F.array_join(ids.cast("array<string>"), ",")).alias("digest"))


@_C.add(f"SELECT doc_id, count(*)::BIGINT AS pairs, sum(a * 256 + b)::BIGINT AS checksum, sum((a = b)::INT)::BIGINT AS doubles FROM ({_PAIRS}) GROUP BY doc_id")
def adjacent_pairs(spark, sf):
    pairs = bpe.pair_counts(_documents(spark, sf), by_document=True)
    return pairs.groupBy("doc_id").agg(F.sum("cnt").alias("pairs"), F.sum((F.col("a") * 256 + F.col("b")) * F.col("cnt")).alias("checksum"), F.sum(F.when(F.col("a") == F.col("b"), F.col("cnt")).otherwise(0)).alias("doubles"))


@_C.add(f"SELECT a, b, count(*)::BIGINT AS cnt, min((doc_id, pos))[1]::BIGINT AS first_doc, min((doc_id, pos))[2]::BIGINT AS first_pos FROM ({_PAIRS}) GROUP BY a, b ORDER BY cnt DESC, min((doc_id, pos)) LIMIT 1")
def top_pair_tiebreak(spark, sf):
    return bpe.top_pair(_documents(spark, sf))


@_C.add(f"{_TRAINED} SELECT doc_id, arg_min(m.a, rank)::INT AS a, arg_min(m.b, rank)::INT AS b, min(rank)::INT AS rank FROM ({_PAIRS}) p JOIN m USING (a, b) GROUP BY doc_id")
def bottom_rank_pair(spark, sf):
    pairs = bpe.pair_counts(_documents(spark, sf), by_document=True)
    ranked = bpe.with_rank(pairs, bpe.merge_table(spark, _merges(spark, sf))).where("rank IS NOT NULL")
    return ranked.groupBy("doc_id").agg(F.min_by("a", "rank").alias("a"), F.min_by("b", "rank").alias("b"), F.min("rank").alias("rank"))


@_C.add(f"{_TRAINED} SELECT a, b, coalesce(rank, 2147483647)::INT AS rank, count(*)::BIGINT AS cnt FROM ({_PAIRS}) LEFT JOIN m USING (a, b) GROUP BY ALL")
def rank_lookup_left(spark, sf):
    counts = bpe.pair_counts(_documents(spark, sf))
    return bpe.with_rank(counts, bpe.merge_table(spark, _merges(spark, sf))).select("a", "b", F.coalesce("rank", F.lit(2_147_483_647)).alias("rank"), "cnt")


@_C.add(f"{_TRAINED} SELECT a, b, count(*)::BIGINT AS cnt FROM ({_PAIRS}) SEMI JOIN m USING (a, b) GROUP BY a, b")
def known_pair_semi(spark, sf):
    counts = bpe.pair_counts(_documents(spark, sf))
    return counts.join(small_side(bpe.merge_table(spark, _merges(spark, sf))), ["a", "b"], "left_semi")


def _folded(string: str, merges: list[tuple[int, int, int]]) -> str:
    for a, b, new in merges:
        string = f"replace({string}, chr({a}) || chr({b}), chr({new}))"
    return string


def _merge_sql(a: int, b: int) -> str:
    return f"SELECT doc_id, length(s)::INT AS n, md5(array_to_string({_IDS.format(s='s')}, ',')) AS digest FROM (SELECT doc_id, {_folded(_STRING, [(a, b, 256)])} AS s FROM documents)"


def _digests(rows):
    ids = B.ids_of(F.col("s"))
    return rows.select("doc_id", F.size(ids).alias("n"), F.md5(F.array_join(ids.cast("array<string>"), ",")).alias("digest"))


@_C.add(_merge_sql(101, 32))
def merge_once(spark, sf):
    return _digests(_documents(spark, sf).withColumn("s", B.merge_pair(B.byte_string(F.col("text")), 101, 32, 256)))


@_C.add(_merge_sql(108, 108))
def merge_self_pair(spark, sf):
    return _digests(_documents(spark, sf).withColumn("s", B.merge_pair(B.byte_string(F.col("text")), 108, 108, 256)))


def _train_sql(rounds: int) -> str:
    steps, string = [f"t0 AS MATERIALIZED (SELECT doc_id, {_STRING} AS s FROM documents)"], "s"
    for r in range(rounds):
        ids = _IDS.format(s="s")
        steps.append(f"""p{r} AS MATERIALIZED (SELECT a, b, count(*)::BIGINT AS cnt FROM (SELECT doc_id, i AS pos, ids[i] AS a, ids[i + 1] AS b FROM (SELECT doc_id, ids, unnest(range(1, len(ids))) AS i FROM (SELECT doc_id, {ids} AS ids FROM t{r})))
          GROUP BY a, b ORDER BY cnt DESC, min((doc_id, pos)) LIMIT 1)""")
        steps.append(f"t{r + 1} AS MATERIALIZED (SELECT doc_id, replace({string}, (SELECT chr(a) || chr(b) FROM p{r}), chr({256 + r})) AS s FROM t{r})")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT {r}::INT AS rank, a::INT AS a, b::INT AS b, {256 + r}::INT AS id FROM p{r}" for r in range(rounds))


@_C.add(_train_sql(3))
def train_3_merges(spark, sf):
    return bpe.merge_table(spark, bpe.train_stream(_documents(spark, sf), 3))


@_C.add(f"{_TRAINED} SELECT rank, a, b, id FROM m")
def train_benchmark(spark, sf):
    """Merges learned from the benchmark texts as one stream each."""
    return bpe.merge_table(spark, _merges(spark, sf))


@_C.add()
def train_stream(spark, sf):
    """The hand-written trainer's 7,936 merges, over all documents; its first three are train_3_merges."""
    return bpe.merge_table(spark, bpe.train_stream(_documents(spark, sf), STREAM_MERGES))


@_C.add()
def bpe_chunk_train(spark, sf):
    """The library trainer's vocabulary: bytes, merges within pre-tokens, and the special token as the last id."""
    merges = bpe.train_chunks(_documents(spark, sf), VOCABULARY - 256 - 1)
    return bpe.vocabulary(spark, merges, SPECIAL).select("id", F.hex("bytes").alias("hex"))


_WORDS = WORD_SPLIT.replace("'", "''")


def _words_sql(rounds: int) -> str:
    pieces = f"SELECT piece, count(*) AS n, min((doc_id, nth)) AS first FROM (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS nth FROM (SELECT doc_id, regexp_extract_all(text, '{_WORDS}') AS ps FROM documents)) GROUP BY piece"
    steps = [f"w0 AS MATERIALIZED (SELECT {_STRING.replace('text', 'piece')} AS s, n, first FROM ({pieces}))"]
    for r in range(rounds):
        steps.append(f"p{r} AS MATERIALIZED (SELECT p FROM (SELECT substr(s, i, 2) AS p, n, (first, i) AS place FROM (SELECT s, n, first, unnest(range(1, length(s))) AS i FROM w{r})) GROUP BY p ORDER BY sum(n) DESC, min(place) LIMIT 1)")
        steps.append(f"w{r + 1} AS MATERIALIZED (SELECT replace(s, (SELECT p FROM p{r}), chr({256 + r})) AS s, n, first FROM w{r})")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT {r}::INT AS rank, unicode(substr(p, 1, 1))::INT AS a, unicode(substr(p, 2, 1))::INT AS b, {256 + r}::INT AS id FROM p{r}" for r in range(rounds))


@_C.add(_words_sql(16))
def train_words(spark, sf):
    """The first merges within pre-tokens, by a pattern that DuckDB has too."""
    return bpe.merge_table(spark, bpe.train_chunks(_documents(spark, sf), 16, WORD_SPLIT))


@_C.add(f"""{_TRAINED} SELECT id, hex FROM (SELECT range::INT AS id, printf('%02X', range) AS hex FROM range(256)
 UNION ALL SELECT id, array_to_string(list_transform({_IDS.format(s='w')}, lambda i: printf('%02X', i)), '') FROM (SELECT id, list_reduce(list_reverse(ms), lambda s, m: replace(s, substr(m, 3, 1), substr(m, 1, 2)), chr(id)) AS w FROM m, l)
 UNION ALL SELECT (SELECT 256 + count(*) FROM m)::INT, hex(encode('{SPECIAL}')))""")
def vocab_closure(spark, sf):
    return bpe.vocabulary(spark, _merges(spark, sf), SPECIAL).select("id", F.hex("bytes").alias("hex"))


def _id_digest(ids):
    return F.md5(F.array_join(ids.cast("array<string>"), ","))


@_C.add(f"{_TRAINED} SELECT doc_id, length(s)::INT AS n, md5(array_to_string({_IDS.format(s='s')}, ',')) AS digest FROM {_ENCODED}")
def encode_fold(spark, sf):
    encoded, _ = _encoded(spark, sf)
    return encoded.select("doc_id", F.size("ids").alias("n"), _id_digest(F.col("ids")).alias("digest"))


_BY_PIECE = f"""{_TRAINED}, ps AS (SELECT doc_id, regexp_extract_all(text, '{_WORDS}') AS ps FROM documents),
 flat AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS nth FROM ps),
 known AS MATERIALIZED (SELECT piece, {_FOLD.format(s=_STRING.replace('text', 'piece'))} AS s FROM (SELECT DISTINCT piece FROM flat), l),
 whole AS (SELECT doc_id, string_agg(s, '' ORDER BY nth) AS s FROM flat JOIN known USING (piece) GROUP BY doc_id)
 SELECT doc_id, coalesce(length(s), 0)::INT AS n, md5(array_to_string({_IDS.format(s="coalesce(s, '')")}, ',')) AS digest FROM documents LEFT JOIN whole USING (doc_id) WHERE text IS NOT NULL"""


@_C.add(_BY_PIECE)
def encode_pieces(spark, sf):
    """Encoding by pre-token: no token crosses the end of one."""
    codec = bpe.Codec(_merges(spark, sf))
    ids = codec.encode_pieces(bpe.pre_tokens(F.col("text"), WORD_SPLIT))
    encoded = _documents(spark, sf).where("text IS NOT NULL").select("doc_id", ids.alias("ids"))
    return encoded.select("doc_id", F.size("ids").alias("n"), _id_digest(F.col("ids")).alias("digest"))


def _named(spark, name: str) -> bpe.Codec:
    return bpe.named_encoding(sources.read_ranks(spark, f"file://{public_tokenizers.path(name)}"))


def _encoded_by_ranks(spark, sf, name):
    codec = _named(spark, name)
    encoded = _documents(spark, sf).where("text IS NOT NULL").select("doc_id", "text", codec.encode_text("text").alias("ids"))
    return encoded.select("doc_id", F.size("ids").alias("n"), _id_digest(F.col("ids")).alias("digest"), codec.decode("ids").eqNullSafe(F.col("text")).alias("whole"))


@_C.add()
def encode_named(spark, sf):
    """Every document by a ready-made vocabulary, its merges recovered from the rank file, and back."""
    return _encoded_by_ranks(spark, sf, "byte_bpe_50k.tiktoken")


@_C.add()
def encode_named_multilingual(spark, sf):
    """The same by the vocabulary for many languages."""
    return _encoded_by_ranks(spark, sf, "byte_bpe_multi_50k.tiktoken")


@_C.add(_BY_PIECE)
def bundle_reload(spark, sf):
    """The learned merges saved as a tokenizer file, opened again, and all documents encoded by what was read."""
    folder = fresh_path(spark, "tokenizer")
    sinks.save_bundle(spark, _merges(spark, sf), folder, special=SPECIAL)
    merges, names, _ = sources.read_tokenizer(spark, folder)
    ids = bpe.Codec(merges, names).encode_text("text", WORD_SPLIT)
    encoded = _documents(spark, sf).where("text IS NOT NULL").select("doc_id", ids.alias("ids"))
    return encoded.select("doc_id", F.size("ids").alias("n"), _id_digest(F.col("ids")).alias("digest"))


@_C.add(f"SELECT lang, a, b, count(*)::BIGINT AS cnt FROM ({_PAIRS}) JOIN documents USING (doc_id) GROUP BY lang, a, b")
def pair_stats_sql(spark, sf):
    """Byte pairs by language from the table function: tasks count, SQL sums what they return."""
    tables.register(spark)
    _documents(spark, sf).createOrReplaceTempView("stats_documents")
    return spark.sql("SELECT key AS lang, a, b, sum(cnt) AS cnt FROM pair_stats(TABLE(SELECT lang AS key, text FROM stats_documents)) GROUP BY key, a, b")


@_C.add(f"SELECT lang, row::BIGINT AS row, n::INT AS n, x_sum::BIGINT AS x_sum FROM (SELECT lang, doc_id, i // {LENGTH} AS row, count(*) AS n, sum(id * (i % {LENGTH} + 1)) AS x_sum FROM (SELECT doc_id, lang, unnest(range(0, len(ids))) AS i, unnest(ids) AS id FROM (SELECT doc_id, lang, {_BYTES} AS ids FROM documents)) GROUP BY ALL) WHERE n = {LENGTH}")
def pack_rows_sql(spark, sf):
    """Each document's bytes as rows of ids from the table function, a partition for each document."""
    tables.register(spark)
    bpe.Codec([]).register(spark, "byte")
    _documents(spark, sf).createOrReplaceTempView("rows_documents")
    rows = spark.sql(f"SELECT * FROM pack_rows(TABLE(SELECT struct(lang, doc_id) AS key, byte_encode(text) AS ids FROM rows_documents) PARTITION BY (key), {LENGTH})")
    return rows.select("key.lang", "row", F.size("x").alias("n"), _weigh("x").alias("x_sum"))


@_C.add("SELECT doc_id, md5(text) AS digest FROM documents")
def decode_fold(spark, sf):
    encoded, codec = _encoded(spark, sf)
    return encoded.select("doc_id", F.md5(codec.decode("ids")).alias("digest"))


@_C.add("SELECT doc_id, md5(text) AS digest FROM documents")
def decode_by_join(spark, sf):
    """Every document by a join of its tokens with the vocabulary; decode_fold is the way that shuffles none."""
    encoded, codec = _encoded(spark, sf)
    # The outer form, as the other brings a filter on ids that encodes every text a second time.
    tokens = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id")).where("pos IS NOT NULL")
    docs = _documents(spark, sf).select("doc_id", F.col("text").isNotNull().alias("encoded"))
    return bpe.decode_join(tokens, bpe.vocabulary(spark, codec.merges), docs).select("doc_id", F.md5("bytes").alias("digest"))


@_C.add("SELECT doc_id, md5(text) AS digest FROM documents")
def decode_all_by_lookup(spark, sf):
    """Every document by lookup in the vocabulary as an array, without Python."""
    encoded, codec = _encoded(spark, sf)
    return bpe.decode_lookup(encoded, F.col("ids"), bpe.vocabulary(spark, codec.merges)).select("doc_id", F.md5("bytes").alias("digest"))


@_C.add("SELECT count(*)::BIGINT AS docs, 0::BIGINT AS failures FROM documents")
def roundtrip_failures(spark, sf):
    encoded, codec = _encoded(spark, sf)
    return encoded.agg(F.count("*").alias("docs"), F.sum((~codec.decode("ids").eqNullSafe(F.col("text"))).cast("int")).alias("failures"))


@_C.add(f"{_TRAINED} SELECT '{{' || string_agg('\"' || a || ',' || b || '\":' || id, ',' ORDER BY rank) || '}}' AS json FROM m")
def merges_json(spark, sf):
    return sinks.merges_json(bpe.merge_table(spark, _merges(spark, sf)))


@_C.add(f"{_TRAINED} SELECT rank, a, b, id FROM m")
def merges_reload(spark, sf):
    path = fresh_path(spark, "merges")
    sinks.merges_json(bpe.merge_table(spark, _merges(spark, sf))).coalesce(1).write.text(path)
    return sources.read_merges_json(spark, path)


@_C.add(f"{_TRAINED} SELECT rank, a, b, id FROM m")
def merges_by_format(spark, sf):
    """The learned merges written and read by format name."""
    formats.register(spark)
    path = fresh_path(spark, "merges")
    bpe.merge_table(spark, _merges(spark, sf)).write.format("merge_json").mode("append").save(path)
    return spark.read.format("merge_json").load(path)


@_C.add(f"""{_TRAINED}, v AS (SELECT i AS id, chr(i::INT) AS s FROM range(256) t(i) UNION ALL SELECT 256 + rank, list_reduce(list_prepend(chr(id), list_reverse(ms)), lambda s, m: replace(s, substr(m, 3, 1), substr(m, 1, 2))) FROM m, l)
 SELECT id::INT AS id, array_to_string(list_transform(regexp_extract_all(s, '(?s).'), lambda c: upper(right('0' || to_hex(unicode(c)), 2))), '') AS hex FROM v""")
def ranks_by_format(spark, sf):
    """The learned vocabulary as a rank file, written and read in spans of a kilobyte by format name."""
    formats.register(spark)
    path = fresh_path(spark, "ranks")
    bpe.vocabulary(spark, _merges(spark, sf)).write.format("token_ranks").mode("append").save(path)
    return spark.read.format("token_ranks").option("split", 1_024).load(path).select("id", F.hex("bytes").alias("hex"))


@_C.add(f"{_TRAINED} SELECT lang, sum(strlen(text))::BIGINT AS bytes, sum(length(s))::BIGINT AS tokens, round(sum(strlen(text)) / sum(length(s)), 6) AS ratio FROM {_ENCODED} GROUP BY lang")
def compression_ratio(spark, sf):
    encoded, _ = _encoded(spark, sf)
    sums = encoded.select("lang", F.octet_length("text").alias("bytes"), F.size("ids").alias("n")).groupBy("lang").agg(F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("n") >= 0, F.col("n"))).alias("tokens"))
    return sums.withColumn("ratio", F.round(F.col("bytes") / F.col("tokens"), 6))


@_C.add(f"{_TRAINED} SELECT doc_id, length(s)::INT + 2 AS n, (SELECT 256 + count(*) FROM m)::INT AS first_id, (SELECT 256 + count(*) FROM m)::INT AS last_id FROM {_ENCODED}")
def bos_eos_wrap(spark, sf):
    encoded, codec = _encoded(spark, sf)
    special = F.array(F.lit(256 + len(codec.merges)))
    wrapped = encoded.select("doc_id", F.concat(special, "ids", special).alias("ids"))
    return wrapped.select("doc_id", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


@_C.add(f"{_TRAINED} SELECT doc_id, length(s)::INT AS n, md5(text) AS digest FROM {_ENCODED}")
def sql_functions(spark, sf):
    """The registered SQL functions: encode, then decode."""
    bpe.Codec(_merges(spark, sf)).register(spark)
    _documents(spark, sf).createOrReplaceTempView("codec_documents")
    return spark.sql("SELECT doc_id, size(ids) AS n, md5(bpe_decode(ids)) AS digest FROM (SELECT doc_id, bpe_encode(text) AS ids FROM codec_documents)")


_SPACE = r"\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The look-ahead in RE2: a mark parts the last white space before a word from those before it, and isn't in any piece.
_MARKED = f"regexp_replace(text, '([{_SPACE}])([{_SPACE}][^{_SPACE}])', '\\1' || chr(57344) || '\\2', 'g')"
_GPT2 = rf"''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}\x{{E000}}]+|[{_SPACE}]+"


def _piece_rows(spark, sf, pattern):
    pieces = bpe.pre_tokens(F.col("text"), pattern)
    return _documents(spark, sf).select("doc_id", F.size(pieces).alias("n"), F.md5(F.array_join(pieces, "\x01")).alias("digest"), (F.array_join(pieces, "") == F.col("text")).alias("whole"))


@_C.add(f"SELECT doc_id, len(ps)::INT AS n, md5(array_to_string(ps, chr(1))) AS digest, true AS whole FROM (SELECT doc_id, regexp_extract_all({_MARKED}, '{_GPT2}') AS ps FROM documents WHERE NOT contains(text, chr(57344)))")
def pretoken_gpt2(spark, sf):
    return _piece_rows(spark, sf, bpe.GPT2_SPLIT)


@_C.add()
def pretoken_indic(spark, sf):
    return _piece_rows(spark, sf, bpe.INDIC_SPLIT)


@_C.add("SELECT piece, count(*)::BIGINT AS cnt FROM (SELECT unnest(regexp_extract_all(text, ' ?[A-Za-z]+| ?[0-9]+')) AS piece FROM documents) GROUP BY piece")
def pretoken_ascii(spark, sf):
    return _documents(spark, sf).select(F.explode(bpe.pre_tokens(F.col("text"), " ?[A-Za-z]+| ?[0-9]+")).alias("piece")).groupBy("piece").agg(F.count("*").alias("cnt"))


def _offsets(spark, sf):
    """(doc_id, n, offset): only two numbers of each document are ordered."""
    sizes = pinned(table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("n")), "sizes")  # texts are read once
    return with_offset(sizes, "doc_id", F.coalesce("n", F.lit(0)).cast("long"))


_FLAT = f"SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS g, id FROM (SELECT doc_id, unnest(range(1, len(ids) + 1)) AS i, unnest(ids) AS id FROM (SELECT doc_id, {_BYTES} AS ids FROM documents))"
_TOTAL = "(SELECT sum(strlen(text)) FROM documents)"


@_C.add("SELECT doc_id, strlen(text)::INT AS n, (sum(strlen(text)) OVER (ORDER BY doc_id) - strlen(text))::BIGINT AS start FROM documents")
def global_offsets(spark, sf):
    return _offsets(spark, sf).select("doc_id", "n", F.col("offset").alias("start"))


@_C.add(f"SELECT id, next_id, count(*)::BIGINT AS cnt FROM (SELECT id, lead(id) OVER (ORDER BY g) AS next_id FROM ({_FLAT})) WHERE next_id IS NOT NULL GROUP BY id, next_id")
def next_token_targets(spark, sf):
    return packing.next_token_pairs(_documents(spark, sf))


@_C.add(f"""SELECT (g // {BATCH * LENGTH})::BIGINT AS batch, ((g % {BATCH * LENGTH}) // {LENGTH})::INT AS row, sum(id * (g % {LENGTH} + 1))::BIGINT AS x_sum, sum(next_id * (g % {LENGTH} + 1))::BIGINT AS y_sum
 FROM (SELECT g, id, lead(id) OVER (ORDER BY g) AS next_id FROM ({_FLAT})) WHERE g // {BATCH * LENGTH} < ({_TOTAL} - 1) // {BATCH * LENGTH} GROUP BY 1, 2""")
def pack_blocks(spark, sf):
    return _packed(spark, sf)[0].select("batch", "row", _weigh("x").alias("x_sum"), _weigh("y").alias("y_sum"))


def _weigh(ids):
    return F.aggregate(F.transform(ids, lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda s, v: s + v)


def _packed(spark, sf):
    """The packed rows of the bytes of all documents, and the number of batches."""
    places = pinned(_offsets(spark, sf).where("n > 0"), "offsets")
    tokens = places.agg(F.max(F.col("offset") + F.col("n"))).first()[0] or 0
    docs = _documents(spark, sf).join(small_side(places), "doc_id").select("offset", bpe.Codec([]).encode("text").alias("ids"))
    return packing.pack(docs, BATCH, LENGTH, tokens), packing.batches_per_epoch(tokens, BATCH, LENGTH)


@_C.add(f"""WITH f AS (SELECT g, id, lead(id) OVER (ORDER BY g) AS next_id FROM ({_FLAT})), n AS (SELECT (({_TOTAL} - 1) // {BATCH * LENGTH})::BIGINT AS n),
 r AS (SELECT (g // {BATCH * LENGTH})::BIGINT AS batch, ((g % {BATCH * LENGTH}) // {LENGTH})::INT AS row, sum(id * (g % {LENGTH} + 1))::BIGINT AS x_sum, sum(next_id * (g % {LENGTH} + 1))::BIGINT AS y_sum FROM f, n WHERE g // {BATCH * LENGTH} < n GROUP BY 1, 2)
 SELECT step::BIGINT AS step, row, x_sum, y_sum FROM n, range(0, 2 * n + 3) t(step) JOIN r ON r.batch = step % n""")
def batches_by_step(spark, sf):
    """x and y of every step of two epochs over the documents and three more, read from a batch store."""
    packed, batches = _packed(spark, sf)
    store = packing.BatchStore.write(packed, fresh_path(spark, "batches"), batches, BATCH, LENGTH, span_tokens=1 << 20)
    return store.between(0, 2 * batches + 3 if batches else 0, _weigh("x").alias("x_sum"), _weigh("y").alias("y_sum"))


@_C.add(f"SELECT n::BIGINT AS tokens, ((n - 1) // {BATCH * LENGTH})::BIGINT AS batches, (n - (n - 1) // {BATCH * LENGTH} * {BATCH * LENGTH})::BIGINT AS dropped FROM (SELECT {_TOTAL} AS n)")
def drop_tail(spark, sf):
    totals = _offsets(spark, sf).agg(F.max(F.col("offset") + F.coalesce("n", F.lit(0))).alias("tokens"))
    batches = F.expr(f"(tokens - 1) div {BATCH * LENGTH}")
    return totals.select("tokens", batches.alias("batches"), (F.col("tokens") - batches * BATCH * LENGTH).alias("dropped"))


@_C.add(f"SELECT lang, (n // {BATCH * LENGTH})::BIGINT AS printed, ((n - 1) // {BATCH * LENGTH})::BIGINT AS batches FROM (SELECT lang, sum(strlen(text)) AS n FROM documents GROUP BY lang)")
def batches_per_epoch(spark, sf):
    sums = _documents(spark, sf).groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"))
    return sums.select("lang", F.expr(f"n div {BATCH * LENGTH}").alias("printed"), F.expr(f"(n - 1) div {BATCH * LENGTH}").alias("batches"))


@_C.add(f"SELECT step::BIGINT AS step, (step % n)::BIGINT AS batch FROM (SELECT (({_TOTAL} - 1) // {BATCH * LENGTH})::BIGINT AS n), range(0, 2 * n + 3) t(step)")
def epoch_cycle(spark, sf):
    """The steps of two epochs over the documents and three more."""
    tokens = _documents(spark, sf).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = packing.batches_per_epoch(tokens, BATCH, LENGTH)
    return packing.epoch_cycle(spark.range(2 * batches + 3).withColumnRenamed("id", "step"), batches)


#: Consecutive doc_ids that make a token stream in each language: streams grow in number with the corpus, not in length.
LANE = 256


@_C.add(f"""WITH t AS (SELECT lang, doc_id // {LANE} AS lane, doc_id, {_BYTES} AS ids FROM documents WHERE text <> ''),
 f AS (SELECT lang, lane, id, row_number() OVER w - 1 AS g, lead(id) OVER w AS next_id, count(*) OVER (PARTITION BY lang, lane) AS n FROM (SELECT lang, lane, doc_id, unnest(range(1, len(ids) + 1)) AS i, unnest(ids) AS id FROM t) WINDOW w AS (PARTITION BY lang, lane ORDER BY doc_id, i))
 SELECT lang, lane::BIGINT AS lane, (g // {LENGTH})::BIGINT AS row, sum(id * (g % {LENGTH} + 1))::BIGINT AS x_sum, sum(next_id * (g % {LENGTH} + 1))::BIGINT AS y_sum FROM f WHERE g // {LENGTH} < (n - 1) // {LENGTH} GROUP BY ALL""")
def pack_stream(spark, sf):
    """All documents as a stream, packed by keyed state; the rows that it wrote."""
    docs = encode.read_documents(small_batches(spark), f"{sf}/documents.parquet*").select("lang", F.expr(f"doc_id div {LANE}").alias("lane"), "doc_id", "text")
    packed, path = pack.pack_stream(docs, ["lang", "lane"], LENGTH, bpe.Codec([])), fresh_path(spark, "packed")
    pack.write_rows(packed, path, fresh_path(spark, "progress")).awaitTermination()
    return spark.read.schema(packed.schema).parquet(path).select("lang", "lane", "row", _weigh("x").alias("x_sum"), _weigh("y").alias("y_sum"))
