"""Pair statistics, BPE training in rounds, vocabularies, encoding and decoding."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import bytes as B
from loomtext.functions import merging as M
from loomtext.session import pinned, small_side, spread, unpinned

#: Bytes or ids that a task's arrays hold at once; a longer text is held whole.
SLICE = 1 << 20
#: Pairs that a round of training starts with and ends with at most, and distinct run ids that it learns from.
HOT_PAIRS, MAX_HOT, RUN_IDS = 256, 1 << 16, 1 << 23
#: Pairs that a first round has at least, and how often they may occur for each run id: most runs occur more than once.
FIRST_HOT, GUESS = 16, 1
#: Codes of pairs that a task sorts at once, and pairs or runs that it holds before it sends them on.
SORTED, HELD = 1 << 23, 1 << 18
#: A task leaves out pairs so rare in it that all tasks together miss less of a pair than this part of the last bound.
MISSED = 128
ID = np.dtype(np.uint16)
MAX_MERGES = 65_536 - 256
PIECE_SPAN = 1 << 32
ROWS = "doc long, base long, weight long, ids binary"

#: The widely published split pattern of byte-level pre-tokenisers, and the one of the tokenizer study
#: that this engine re-expresses for Devanagari (U+0900-097F) and Kannada (U+0C80-0CFF), whose words keep their vowel
#: signs. Mended in it: word classes end before the dandas (U+0964-0965), which split off, and the ranges are written
#: as escapes.
GPT2_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
INDIC_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\b[\p{L}\u0900-\u0963\u0966-\u097F]+\b| ?\b[\p{L}\u0C80-\u0C9E\u0CA0-\u0CFF]+\b| ?\p{N}+| ?[.,!?;:'\"-]| ?[\u0964-\u0965]| ?[\u0C9E-\u0C9F]| ?[^\s\p{L}\p{N}\u0900-\u097F\u0C80-\u0CFF]+|\s+(?!\S)|\s+"
#: Case is ignored, and what the pattern leaves between its matches (letters beside digits, say) are pieces too.
INDIC_SPLIT = f"(?i)(?:{INDIC_WORDS})|(?:(?!{INDIC_WORDS})[\\s\\S])+"


def pre_tokens(text: Column, pattern: str = GPT2_SPLIT) -> Column:
    """The pieces of a text; together they are the text. Classes are Unicode's, white space and word ends included."""
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))


def positioned_pairs(docs: DataFrame, ids: Column) -> DataFrame:
    """(doc_id, pos, a, b), pos from 0; pairs never cross documents."""
    return docs.select("doc_id", F.posexplode(B.pairs_of(ids)).alias("pos", "p")).select("doc_id", "pos", "p.a", "p.b")


def pair_counts(docs: DataFrame, text: str = "text", *, by_document: bool = False, weight: str | None = None) -> DataFrame:
    """(a, b, cnt) of adjacent UTF-8 bytes, overlapping occurrences counted; with doc_id if `by_document`. A text counts
    as often as the whole number in the column `weight` says, below 0 too.

    A task sums what it reads into a table of 65,536 cells (or a document's own pairs); only sums are shuffled.
    """

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(65_536, np.int64)
        for batch in batches:
            for i, ids, bounds in _byte_slices(batch["text"].tolist()):
                at = M.adjacent(bounds)
                times = None if weight is None else batch["weight"].to_numpy()[i + np.searchsorted(bounds, at, side="right") - 1]
                cells += np.bincount(ids[at] * 256 + ids[at + 1], times, minlength=65_536).astype(np.int64)
        seen = np.flatnonzero(cells)
        yield pd.DataFrame({"a": seen >> 8, "b": seen & 255, "cnt": cells[seen]})

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, ids, bounds in _byte_slices(batch["text"].tolist()):
                at = M.adjacent(bounds)
                owner = np.searchsorted(bounds, at, side="right") - 1
                cell, n = np.unique(owner * 65_536 + ids[at] * 256 + ids[at + 1], return_counts=True)
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[i + cell // 65_536].array, "a": cell // 256 % 256, "b": cell % 256, "cnt": n})

    if by_document:
        return docs.select("doc_id", F.col(text).alias("text")).mapInPandas(apart, "doc_id long, a int, b int, cnt long")
    columns = [F.col(text).alias("text")] + ([] if weight is None else [F.col(weight).cast("long").alias("weight")])
    return docs.select(*columns).mapInPandas(whole, "a int, b int, cnt long").groupBy("a", "b").agg(F.sum("cnt").alias("cnt"))


def byte_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, cnt) of the bytes of all texts; a task sums what it reads into 256 cells."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(256, np.int64)
        for batch in batches:
            for _, ids, _ in _byte_slices(batch["text"].tolist()):
                cells += np.bincount(ids, minlength=256)
        seen = np.flatnonzero(cells)
        yield pd.DataFrame({"id": seen, "cnt": cells[seen]})

    return docs.select(F.col(text).alias("text")).mapInPandas(count, "id int, cnt long").groupBy("id").agg(F.sum("cnt").alias("cnt"))


def _byte_slices(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, ids, bounds) for stretches of about SLICE bytes."""
    raw = [(t or "").encode("utf-8") for t in texts]
    for i, j in _slices([len(r) for r in raw]):
        yield i, np.frombuffer(b"".join(raw[i:j]), np.uint8).astype(np.int64), M.bounds_of([len(r) for r in raw[i:j]])


def _slices(lengths: Sequence[int]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, n in enumerate(lengths):
        held += n
        if held >= SLICE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def _rows_in(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(rows, ids, bounds) of stretches of a batch of encoded rows."""
    for i, j in _slices([len(x) // ID.itemsize for x in batch["ids"]]):
        some = batch.iloc[i:j]
        yield some, np.frombuffer(b"".join(some["ids"]), ID).astype(np.int64), M.bounds_of([len(x) // ID.itemsize for x in some["ids"]])


def encoded_rows(docs: DataFrame) -> DataFrame:
    """(doc, base, weight, ids) of the texts of docs (doc_id, text): UTF-8 bytes as ids, of weight 1."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [np.frombuffer(t.encode("utf-8"), np.uint8).astype(ID).tobytes() for t in batch["text"]]
            yield batch[["doc", "base", "weight"]].assign(ids=ids)

    texted = docs.where("text IS NOT NULL")
    for name, default in (("doc", F.coalesce("doc_id", F.lit(-(1 << 63)))), ("base", F.lit(0)), ("weight", F.lit(1))):
        texted = texted if name in docs.columns else texted.withColumn(name, default.cast("long"))
    return texted.select("doc", "base", "weight", "text").mapInPandas(read, ROWS)


def pair_sums(rows: DataFrame) -> DataFrame:
    """(a, b, cnt, doc, pos) of encoded rows: a pair's weight and its first place."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some, ids, bounds in _rows_in(batch):
                # Rows in the order of their places: one number then stands for both parts of a place.
                order = np.lexsort((some["base"], some["doc"]))
                rank = np.empty(len(some), np.int64)
                rank[order] = np.arange(len(some))
                code, n, least = M.sum_pairs(ids, bounds, some["weight"].to_numpy(), rank << 32)
                row = order[least >> 32]
                yield pd.DataFrame({"a": code >> 32, "b": code & 0xFFFFFFFF, "cnt": n, "doc": some["doc"].to_numpy()[row], "pos": some["base"].to_numpy()[row] + (least & 0xFFFFFFFF)})

    found = rows.mapInPandas(count, "a int, b int, cnt long, doc long, pos long")
    return found.groupBy("a", "b").agg(F.sum("cnt").alias("cnt"), F.min(F.struct("doc", "pos")).alias("at")).select("a", "b", "cnt", "at.doc", "at.pos")


def top_pairs(rows: DataFrame, n: int) -> DataFrame:
    """The n most frequent pairs, of equally frequent ones those that occur first."""
    return pair_sums(rows).orderBy(F.desc("cnt"), "doc", "pos", "a", "b").limit(n)


def top_pair(docs: DataFrame) -> DataFrame:
    """(a, b, cnt, first_doc, first_pos): the most frequent byte pair; of equals the one that occurs first."""
    return top_pairs(encoded_rows(docs), 1).select("a", "b", "cnt", F.col("doc").alias("first_doc"), F.col("pos").alias("first_pos"))


def runs_of(rows: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(run, weight, doc, pos): the distinct longest runs of ids whose adjacent pairs are all among `pairs`, with
    their weights and first places. A task sums up its distinct runs: what is shuffled follows them, not the corpus."""
    hot = M.PairSet(pairs)

    def frame(held: dict[bytes, tuple]) -> pd.DataFrame:
        weight, doc, pos = zip(*held.values()) if held else ((), (), ())
        return pd.DataFrame({"run": list(held), "weight": weight, "doc": doc, "pos": pos})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, tuple] = {}
        for batch in batches:
            for some, ids, bounds in _rows_in(batch.sort_values(["doc", "base"], ignore_index=True)):
                first, last = hot.runs(ids, bounds)
                owner = np.searchsorted(bounds, first, side="right") - 1
                doc, base = some["doc"].to_numpy(), some["base"].to_numpy()
                pos, weight, doc = base[owner] + first - bounds[owner], some["weight"].to_numpy()[owner], doc[owner]
                # Rows at one place may have its first occurrence in any of them; otherwise that is the first in order.
                one_place = ((np.diff(some["doc"]) == 0) & (np.diff(some["base"]) == 0)).any()
                for run, w, at in M.distinct_runs(ids.astype(ID), first, last, weight, (doc, pos) if one_place else None):
                    for r, n, d, p in zip(run, w.tolist(), doc[at].tolist(), pos[at].tolist()):
                        known = held.get(r)
                        if known is None:
                            held[r] = (n, d, p)
                        else:
                            held[r] = (known[0] + n, *min(known[1:], (d, p)))
                if len(held) >= HELD:
                    yield frame(held)
                    held = {}
        yield frame(held)

    found = rows.mapInPandas(cut, "run binary, weight long, doc long, pos long")
    return found.groupBy("run").agg(F.sum("weight").alias("weight"), F.min(F.struct("doc", "pos")).alias("at")).select("run", "weight", "at.doc", "at.pos")


def learned(runs: DataFrame, wanted: int, first_id: int, worst: tuple[int, int, int] | None) -> list[M.Merge]:
    """Merges learned from the distinct runs (at most RUN_IDS ids), in one task, while they are better than a pair of the
    weight and first place (cnt, doc, pos) of `worst`."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(batches) or [pd.DataFrame({"run": [], "weight": [], "doc": [], "pos": []})], ignore_index=True)
        held = held.iloc[np.lexsort((held["pos"].to_numpy(np.int64), held["doc"].to_numpy(np.int64)))]
        if held.duplicated(["doc", "pos"]).any():  # runs of several rows at one place
            held = held.sort_values(["doc", "pos", "run"])
        before = None if worst is None else (worst[0], int(((held["doc"] < worst[1]) | ((held["doc"] == worst[1]) & (held["pos"] <= worst[2]))).sum()))
        ids, bounds = np.frombuffer(b"".join(held["run"]), ID).astype(np.int64), M.bounds_of([len(r) // ID.itemsize for r in held["run"]])
        found = M.learn(ids, bounds, held["weight"].to_numpy(np.int64), wanted, first_id, before)
        yield pd.DataFrame(found, columns=["a", "b", "id"])

    rows = runs.coalesce(1).mapInPandas(learn, "a int, b int, id int").collect()
    return sorted((tuple(r) for r in rows), key=lambda m: m[2])


def rewritten(rows: DataFrame, merges: Sequence[M.Merge], least: int = 0) -> DataFrame:
    """(doc, base, weight, ids, pairs): encoded rows with further merges applied and, in rows of their own that have
    `pairs` in place of ids, what the pairs in a task then weigh: codes of 32 bits, then sums of 64. A task leaves out
    pairs of at most `least`; the `weight` of such a row says whether it left out any."""
    table = M.MergeTable(merges)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = M.PairSums(SORTED)
        for batch in batches:
            for some, ids, bounds in _rows_in(batch):
                ids, bounds = table.encode_repeated(ids, bounds)
                raw, cut = ids.astype(ID).tobytes(), (bounds * ID.itemsize).tolist()
                sums.add(ids, bounds, some["weight"].to_numpy())
                yield some[["doc", "base", "weight"]].assign(ids=[raw[i:j] for i, j in zip(cut, cut[1:])], pairs=None)
        code, n = sums.result()
        often = n > least
        short, code, n = int(not often.all()), code[often], n[often]
        for i in range(0, max(1, len(code)), HELD):
            packed = code[i : i + HELD].tobytes() + n[i : i + HELD].tobytes()
            yield pd.DataFrame({"doc": [i], "base": [0], "weight": [short], "ids": [None], "pairs": [packed]})

    return rows.mapInPandas(apply, f"{ROWS}, pairs binary")


def heaviest(kept: DataFrame, n: int, least: int) -> tuple[list[tuple[int, int, int]], int]:
    """(a, b, cnt) of the n heaviest pairs by the sums that tasks kept, and how much of any pair they may have left out:
    at most `least` for each task that left out any."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for packed in batch["pairs"]:
                k = len(packed) // 12
                if not k:
                    continue
                code = np.frombuffer(packed, np.uint32, k).astype(np.int64)
                yield pd.DataFrame({"a": code >> 16, "b": code & 0xFFFF, "cnt": np.frombuffer(packed, np.int64, k, 4 * k)})

    tables = kept.where("pairs IS NOT NULL")
    short = least * tables.where("doc = 0 AND weight = 1").count() if least else 0
    summed = tables.select("pairs").mapInPandas(unpack, "a int, b int, cnt long").groupBy("a", "b").agg(F.sum("cnt").alias("cnt"))
    return [tuple(r) for r in summed.orderBy(F.desc("cnt"), "a", "b").limit(n).collect()], short


def train(rows: DataFrame, merges: int, *, hot: int = HOT_PAIRS, run_ids: int = RUN_IDS) -> list[M.Merge]:
    """Merges (a, b, id), exactly those that a count after every merge would give; stops when no pair is left.

    A round takes the `hot` best pairs and the distinct runs of ids that only such pairs join. A pair that merging can
    still make is never more frequent than any pair in its expansion, so until the best pair is no better than the
    best one that isn't hot, all that decides is in those runs: merges are learned from them, weighted, and then
    applied to the rows in parallel, which counts the pairs for the next round in passing. Any bound above the best
    pair that isn't hot will do, so tasks leave out what is rare in them; a round that learns nothing by such a bound
    counts all pairs with their places. Runs of more than `run_ids` ids in all make the round start over with fewer
    hot pairs; with one, they are one pair's. Rounds follow how far frequencies fall, not the number of merges.
    """
    if merges > MAX_MERGES:
        raise ValueError(f"{merges} merges need ids of more than {ID.itemsize} bytes")
    found: list[M.Merge] = []
    kept, least, exact = pinned(rewritten(rows, []), "bytes"), 0, False
    while len(found) < merges:
        hot = min(hot, max(FIRST_HOT, 8 * (merges - len(found))))
        rows = kept.where("ids IS NOT NULL").select("doc", "base", "weight", "ids")
        if exact:
            placed = top_pairs(rows, hot + 1).collect()
            best = [(r["a"], r["b"], r["cnt"]) for r in placed]
        else:
            best, missed = heaviest(kept, hot + 1, least)
        if not found:  # a first guess that spares large corpora the passes of too many pairs
            hot = min(hot, max(FIRST_HOT, sum(n <= GUESS * run_ids for n in accumulate(n for _, _, n in best))))
        while True:
            if exact:
                stop = (placed[hot]["cnt"], placed[hot]["doc"], placed[hot]["pos"]) if len(placed) > hot else None
            else:
                bound = missed + (best[hot][2] if len(best) > hot else 0)
                stop = (bound, -(1 << 63), -1) if bound else None
            runs = pinned(runs_of(rows, [(a, b) for a, b, _ in best[:hot]]), "runs")
            held = (runs.agg(F.sum(F.length("run"))).first()[0] or 0) // ID.itemsize
            if held <= run_ids or hot == 1:
                break
            unpinned(runs)
            hot = max(1, hot // (2 if held < 2 * run_ids else 4))
        more = learned(runs, merges - len(found), 256 + len(found), stop)
        unpinned(runs)
        if not more and exact:
            break
        exact = not more
        if exact:
            continue
        found += more
        if len(found) < merges:
            before, tasks = kept, rows.rdd.getNumPartitions()
            least = stop[0] // (MISSED * tasks) if stop else 0
            kept = pinned(rewritten(rows, more, least), "merged")
            unpinned(before)
        if held < run_ids // 2:
            hot = min(MAX_HOT, hot * (4 if held < run_ids // 4 else 2))
    unpinned(kept)
    return found


def train_stream(docs: DataFrame, merges: int, **options) -> list[M.Merge]:
    """Merges learned from whole texts: they may join words, never documents. Documents count in the order of doc_id
    (null first); rows of one doc_id are at one place, so that equally frequent pairs of theirs may tie, then by id."""
    return train(encoded_rows(docs), merges, **options)


def train_chunks(docs: DataFrame, merges: int, pattern: str = GPT2_SPLIT, **options) -> list[M.Merge]:
    """As train_stream, over distinct pre-tokens weighted by their counts: merges stay within pre-tokens."""
    pieces = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.posexplode(pre_tokens(F.col("text"), pattern)).alias("nth", "text"))
    # A piece's place is PIECE_SPAN times its number in its document: pairs within it are fewer than that.
    place = F.min(F.struct("doc", (F.col("nth").cast("long") * PIECE_SPAN).alias("base")))
    counted = pieces.groupBy("text").agg(F.count("*").alias("weight"), place.alias("at"))
    return train(encoded_rows(counted.select("at.doc", "at.base", "weight", "text")), merges, **options)


class Codec:
    """A merge table as columns: texts to ids and back.

    The table goes to the tasks with the functions, so it is bounded: more than MAX_MERGES merges raise. Merging is
    lowest rank first, over whole texts or within given pieces. Null in, null out; no text is no ids.

    `names`, if given, are the ids that the 256 bytes and then the merges go by outside; a piece that is one of the
    tokens `whole` is that token, whatever its bytes would merge to.
    """

    def __init__(self, merges: Sequence[M.Merge], names: Sequence[int] | None = None, whole: Mapping[bytes, int] | None = None):
        if len(merges) > MAX_MERGES:
            raise ValueError(f"a table of {len(merges)} merges is over {MAX_MERGES}")
        self.merges = [tuple(map(int, m)) for m in merges]
        named = None if names is None else np.array(names, np.int32)
        single = {} if whole is None else {token.decode("utf-8", "surrogateescape"): np.array([i], np.int32) for token, i in whole.items()}
        table, own = M.MergeTable(self.merges), words_of(self.merges).values()
        by_id = dict(zip(range(len(own)) if names is None else names, own)) | {i: token for token, i in (whole or {}).items()}
        words = [by_id.get(i) for i in range(max(by_id) + 1)]

        def encoded(texts: list[str | None]) -> Iterator[np.ndarray]:
            for _, ids, bounds in _byte_slices(texts):
                ids, bounds = table.encode(ids, bounds)
                ids, cuts = ids.astype(np.int32) if named is None else named[ids], bounds.tolist()
                yield from (ids[i:j] for i, j in zip(cuts, cuts[1:]))

        def joined(ids) -> bytes:
            try:
                if min(ids, default=0) < 0:
                    raise IndexError
                return b"".join([words[i] for i in ids])
            except (IndexError, TypeError):
                raise ValueError(f"unknown token id {next(i for i in ids if i is None or not 0 <= i < len(words) or words[i] is None)}") from None

        @F.pandas_udf("array<int>")
        def encode(texts: pd.Series) -> pd.Series:
            values = texts.tolist()
            return pd.Series([None if t is None else x for t, x in zip(values, encoded(values))], dtype=object)

        @F.arrow_udf("array<int>")
        def encode_pieces(pieces: pa.Array) -> pa.Array:
            # Each distinct piece is encoded once; the texts' ids are then gathered without a step for each piece.
            flat = pc.fill_null(pieces.flatten(), "").dictionary_encode()
            distinct = flat.dictionary.to_pylist()
            known = [single.get(x, ids) for x, ids in zip(distinct, encoded(distinct))]
            which = flat.indices.to_numpy()
            size = np.array([len(x) for x in known], np.int64)
            ids, starts = np.concatenate([np.zeros(0, np.int32), *known]), M.bounds_of(size)[:-1]
            ends = M.bounds_of(size[which])
            ids = ids[np.arange(ends[-1]) + np.repeat(starts[which] - ends[:-1], size[which])]
            counts = M.bounds_of(pc.fill_null(pc.list_value_length(pieces), 0).to_numpy())
            mask = pieces.is_null() if pieces.null_count else None
            return pa.ListArray.from_arrays(pa.array(ends[counts].astype(np.int32)), pa.array(ids, pa.int32()), mask=mask)

        @F.pandas_udf("binary")
        def decode_bytes(ids: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else joined(x.tolist()) for x in ids], dtype=object)

        @F.pandas_udf("string")
        def decode(ids: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else joined(x.tolist()).decode("utf-8", "replace") for x in ids], dtype=object)

        self.encode, self.encode_pieces, self.decode_bytes, self.decode = encode, encode_pieces, decode_bytes, decode
        self.encoded = encoded  # for the tasks of other operators

    def encode_text(self, text: Column | str, pattern: str = GPT2_SPLIT) -> Column:
        """A text's ids, piece by piece."""
        return self.encode_pieces(pre_tokens(F.col(text) if isinstance(text, str) else text, pattern))

    def register(self, spark: SparkSession, prefix: str = "bpe") -> None:
        """SQL functions <prefix>_encode(text), _encode_pieces(array), _decode(ids), _decode_bytes(ids)."""
        for name in ("encode", "encode_pieces", "decode", "decode_bytes"):
            spark.udf.register(f"{prefix}_{name}", getattr(self, name))


def recovered(ranks: DataFrame) -> tuple[DataFrame, dict[bytes, int]]:
    """(rank, a, b, id) and the tokens by id, of a rank file's table (id, bytes) in which a token's id is its rank.

    Rank files don't say which two tokens a merge joins: they are what a token's own bytes come to by the merges of
    lower rank. A token that doesn't come to two, so that no merge makes it, has null for both. A vocabulary is
    bounded: more than MAX_MERGES + 256 tokens raise, as do missing bytes, repeated ids and repeated tokens.
    """
    rows = ranks.select("id", "bytes").limit(MAX_MERGES + 257).collect()
    tokens = {bytes(r["bytes"]): r["id"] for r in rows}
    if len(rows) > MAX_MERGES + 256:
        raise ValueError(f"a rank file of over {MAX_MERGES + 256} tokens")
    if len(tokens) < len(rows) or len(set(tokens.values())) < len(rows):
        raise ValueError("a rank file with a token or an id twice")
    if missing := [b for b in range(256) if bytes([b]) not in tokens]:
        raise ValueError(f"a rank file without the byte {missing[0]}")
    shared = ranks.sparkSession.sparkContext.broadcast(tokens)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for batch in batches:
            pairs = [M.parts_below(bytes(token), held, rank) for rank, token in zip(batch["id"], batch["bytes"])]
            ids = [[held[p] for p in pair] if len(pair) == 2 else [None, None] for pair in pairs]
            yield pd.DataFrame({"rank": batch["id"], "a": pd.array([x[0] for x in ids], "Int32"), "b": pd.array([x[1] for x in ids], "Int32"), "id": batch["id"]})

    return spread(ranks.where(F.octet_length("bytes") > 1).select("id", "bytes")).mapInPandas(split, "rank int, a int, b int, id int"), tokens


def named_encoding(ranks: DataFrame) -> Codec:
    """The codec of a rank file's table (id, bytes): the ids that the file gives, bytes included. Texts are encoded by
    `encode_text`, piece by piece."""
    pairs, tokens = recovered(ranks)
    rows = sorted(pairs.collect())  # as many as the vocabulary has tokens
    joined = [r for r in rows if r["a"] is not None]
    names = [tokens[bytes([b])] for b in range(256)] + [r["id"] for r in joined]
    inner = {name: i for i, name in enumerate(names)}
    words = {i: token for token, i in tokens.items()}
    # A part that no merge makes can't come up, so neither can its merge.
    possible = [r for r in joined if r["a"] in inner and r["b"] in inner]
    if len(possible) < len(joined):
        raise ValueError("a rank file whose merges need tokens that no merge makes")
    merges = [(inner[r["a"]], inner[r["b"]], inner[r["id"]]) for r in joined]
    return Codec(merges, names, {words[r["id"]]: r["id"] for r in rows if r["a"] is None})


def register_pairs(spark: SparkSession) -> None:
    """SQL function byte_pairs(text): array of (a, b, cnt) of a text's adjacent bytes, by (a, b)."""

    @F.pandas_udf("array<struct<a: int, b: int, cnt: bigint>>")
    def byte_pairs(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            ids = np.frombuffer((text or "").encode("utf-8"), np.uint8).astype(np.int64)
            cell, n = np.unique(ids[:-1] * 256 + ids[1:], return_counts=True)
            out.append(None if text is None else [{"a": int(c) >> 8, "b": int(c) & 255, "cnt": int(k)} for c, k in zip(cell, n)])
        return pd.Series(out, dtype=object)

    spark.udf.register("byte_pairs", byte_pairs)


def merge_table(spark: SparkSession, merges: list[tuple[int, int, int]]) -> DataFrame:
    """(rank, a, b, id)."""
    return spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "rank int, a int, b int, id int")


def words_of(merges: Sequence[M.Merge]) -> dict[int, bytes]:
    """The bytes of every id: the 256 bytes, then each merge's two parts joined."""
    parts = {i: bytes([i]) for i in range(256)}
    for a, b, new in merges:
        parts[new] = parts[a] + parts[b]
    return parts


def vocabulary(spark: SparkSession, merges: Sequence[M.Merge], special: str | None = None) -> DataFrame:
    """(id, bytes) in the order of ids; a special token, if any, is the last."""
    words = list(words_of(merges).items()) + ([(256 + len(merges), special.encode())] if special is not None else [])
    return spark.createDataFrame([(i, bytearray(p)) for i, p in words], "id int, bytes binary")


def with_rank(pairs: DataFrame, merges: DataFrame) -> DataFrame:
    """Pairs with their rank, null where none; a merge table counted to be small is broadcast."""
    return pairs.join(small_side(merges.select("a", "b", "rank")), ["a", "b"], "left")


#: Token rows that a task lays end to end at once.
DECODE_ROWS = 1 << 16


def _laid_end_to_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, pos, bytes) with rows of one document that follow each other, position by position, made one row."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        # Values of a binary array lie end to end as they are: longer values need no more than fewer offsets.
        _, offsets, data = rows["bytes"].buffers()
        starts = np.frombuffer(offsets, np.int32)[rows["bytes"].offset :][: len(rows) + 1]
        doc, known = rows["doc_id"].fill_null(0).to_numpy(), rows["doc_id"].is_valid().to_numpy(zero_copy_only=False)
        pos = rows["pos"].to_numpy()
        follows = (doc[1:] == doc[:-1]) & (known[1:] == known[:-1]) & (pos[1:] == pos[:-1] + 1)
        heads = np.concatenate([[0], np.flatnonzero(~follows) + 1])
        cuts = pa.py_buffer(np.append(starts[heads], starts[-1]).astype(np.int32).tobytes())
        whole = pa.Array.from_buffers(pa.binary(), len(heads), [None, cuts, data])
        return pa.RecordBatch.from_arrays([rows["doc_id"].take(pa.array(heads)), rows["pos"].take(pa.array(heads)), whole], ["doc_id", "pos", "bytes"])

    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= DECODE_ROWS:
            yield joined()
    if held:
        yield joined()


def decode_join(tokens: DataFrame, vocab: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, bytes) for docs (doc_id, encoded) from tokens (doc_id, pos, id) by lookup and ordered concatenation; an unknown id raises.

    An encoded document without tokens has no bytes; one that wasn't encoded, for want of a text, has null. Tokens that
    follow each other are put together where they are, so that stretches of text are shuffled in place of tokens; the
    fewer stand in order, the more rows. A doc_id is one document.
    """
    known = tokens.join(small_side(vocab), "id", "left")
    checked = F.when(F.col("bytes").isNull(), F.raise_error(F.concat(F.lit("unknown token id "), F.col("id").cast("string"))).cast("binary")).otherwise(F.col("bytes"))
    rows = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("pos").cast("int").alias("pos"), checked.alias("bytes"))
    parts = rows.mapInArrow(_laid_end_to_end, "doc_id long, pos int, bytes binary").select("doc_id", "pos", F.hex("bytes").alias("h"))
    whole = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda e: e["h"]), "").alias("h"))
    return docs.join(whole, "doc_id", "left").select("doc_id", F.unhex(F.coalesce("h", F.when(F.col("encoded"), F.lit("")))).alias("bytes"))


def decode_lookup(docs: DataFrame, ids: Column, vocab: DataFrame) -> DataFrame:
    """docs with `bytes`: each row's ids looked up in the whole vocabulary (ids 0 to n - 1) and joined in order.

    The vocabulary is one array, bounded by its size; a document is decoded where it is, so no token is shuffled and
    rows of one doc_id stay apart. An unknown id raises; no ids are no bytes, null ids null.
    """
    words = vocab.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.hex("bytes").alias("h")))), lambda e: e["h"]).alias("words"))
    unknown = lambda i: F.raise_error(F.concat(F.lit("unknown token id "), F.coalesce(i.cast("string"), F.lit("null"))))
    looked_up = docs.withColumn("__words", words.scalar()).withColumn("__found", F.transform(ids, lambda i: F.coalesce(F.get("__words", i), unknown(i))))
    return looked_up.withColumn("bytes", F.unhex(F.array_join("__found", ""))).drop("__words", "__found")
