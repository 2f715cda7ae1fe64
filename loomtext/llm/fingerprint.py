"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, cut at sentence ends, and in them runs of a few words. Runs are cut at places chosen
by a hash of the characters around them, so an edit only changes the paragraphs that it touches. Runs are shorter
where a text begins (RADII), so that short texts have several as well. Each paragraph, with its repeat number in the text, is a 64-bit digest. A sketch of m cells adds every
digest to one cell of each of three subtables: count, sum of digests and sum of their check hashes, modulo 2^64.
Two sketches of one size subtract cell by cell; what both texts hold cancels. Peeling then recovers the digests of
differing paragraphs from cells of one digest. If it gets stuck, both texts are sketched anew in more cells, up to RETRIES
times, and then compared as sets.

The likeness of two texts is shared / (shared + differing) paragraphs, from what peeling recovered and the numbers of
paragraphs that fingerprints carry. A fingerprint is "n:m:" and the base64 of its m cells.

Defined cases: a null text is an empty one, with no paragraphs; two empty texts have likeness 1. Rows are ordered by
(doc_id, hash of text), descending, null doc_ids last; so repeated rows follow each other, and a single row is its own next. An
empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.tokens import mix

LONG = 240
CELLS = 15
GROW = 4
#: Cells for each digest after a failure, and how often a pair is sketched anew.
LOAD, RETRIES = 1.5, 3
BUCKET_BYTES, LEAST_BYTES = 16 << 20, 1 << 18
_BATCH_CHARS = 1 << 20
#: (up to this many characters from the start, radius): a place is cut if its hash is least among the places around it.
RADII = ((64, 0), (512, 1), (1 << 62, 3))
LONG_WORD = 16
NEAR = 4
_STOPS = np.array([ord(c) for c in ".!?"], np.uint32)
RESULT = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _cuts(text: str) -> np.ndarray:
    """Where paragraphs start, but the first: after line and sentence ends, and at the least hashes of their surroundings.

    Places are word starts; in words of over LONG_WORD characters (text without spaces) a hashed quarter of all characters.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(codes)
    end, space = codes == 10, codes == 32
    end[1:] |= space[1:] & np.isin(codes[:-1], _STOPS)
    lengths = np.diff(np.flatnonzero(np.concatenate([[True], (codes == 10) | space, [True]]))) - 1
    inside = np.repeat(lengths > LONG_WORD, lengths + 1)[:n]
    at = np.flatnonzero((end | space | inside)[:-1]) + 1
    padded = np.concatenate([np.zeros(NEAR, np.uint64), codes.astype(np.uint64), np.zeros(NEAR, np.uint64)])
    h = np.zeros(len(at), np.uint64)
    for k in range(2 * NEAR):
        h = h * np.uint64(0x9E3779B97F4A7C15) + padded[at + k]
    h = mix(h)
    kept = (end | space)[at - 1] | (h % np.uint64(4) == 0)
    at, h = at[kept], h[kept] | np.uint64(1)
    h[end[at - 1]] = 0
    radius = np.array([r for _, r in RADII])[np.searchsorted([to for to, _ in RADII], at, side="right")]
    most = max(r for _, r in RADII)
    around = np.pad(h, most, constant_values=np.uint64(0xFFFFFFFFFFFFFFFF))
    least = np.ones(len(at), bool)
    for k in range(1, most + 1):
        before, after = around[most - k : most - k + len(h)], around[most + k : most + k + len(h)]
        least &= (k > radius) | (h < before) & (h <= after)
    return at[least | (h == 0)]


def paragraphs(text: str) -> list[str]:
    """The parts of a text without line ends; only runs of equal surroundings get over LONG characters, and are cut there."""
    out: list[str] = []
    start = 0
    for stop in [*(_cuts(text).tolist() if text else ()), len(text)]:
        part = text[start:stop].removesuffix("\n")
        out.extend(part[i : i + LONG] for i in range(0, len(part), LONG))
        start = stop
    return out


def digests(text: str) -> np.ndarray:
    """One digest for each paragraph; equal paragraphs are told apart by their repeat numbers."""
    raw = np.array([xxhash.xxh64_intdigest(p) for p in paragraphs(text)], np.uint64)
    ordered = np.sort(raw)
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(raw) else np.zeros(0, bool)
    place = np.arange(len(ordered))
    return mix(ordered + (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64))


class Sketches:
    """Sketches of many texts, one row each, in m cells."""

    def __init__(self, sets: Sequence[np.ndarray], m: int):
        n = len(sets)
        self.m = m
        self.count, self.total, self.check = np.zeros((n, m), np.int64), np.zeros((n, m), np.uint64), np.zeros((n, m), np.uint64)
        keys = np.concatenate([np.zeros(0, np.uint64), *sets])
        self.add(np.repeat(np.arange(n), [len(s) for s in sets]), keys, np.ones(len(keys), np.int64))

    def cells(self, keys: np.ndarray, table: int) -> np.ndarray:
        part = self.m // 3
        return table * part + (mix(keys + np.uint64(self.m * 3 + table)) % np.uint64(part)).astype(np.int64)

    def add(self, row: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        factor, check = sign.astype(np.uint64), mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        for table in range(3):
            flat = row * self.m + self.cells(keys, table)
            np.add.at(self.count.ravel(), flat, sign)
            np.add.at(self.total.ravel(), flat, keys * factor)
            np.add.at(self.check.ravel(), flat, check * factor)

    def __sub__(self, other: Sketches) -> Sketches:
        out = object.__new__(Sketches)
        out.m = self.m
        out.count, out.total, out.check = self.count - other.count, self.total - other.total, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, digest, sign) of what was recovered, and which rows came out empty: those are whole."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        part = self.m // 3
        idle = 0
        table = 0
        while idle < 3:
            area = slice(table * part, (table + 1) * part)
            row, cell = np.nonzero(np.abs(self.count[:, area]) == 1)
            sign = self.count[:, area][row, cell]
            factor = sign.astype(np.uint64)
            key = self.total[:, area][row, cell] * factor
            pure = (self.check[:, area][row, cell] * factor == mix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5))) & (self.cells(key, table) == cell + table * part)
            row, key, sign = row[pure], key[pure], sign[pure]
            idle = 0 if len(row) else idle + 1
            if len(row):
                self.add(row, key, -sign)
                found.append((row, key, sign))
            table = (table + 1) % 3
        whole = ~((self.count != 0).any(axis=1) | (self.total != 0).any(axis=1) | (self.check != 0).any(axis=1))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), whole
        return *(np.concatenate(x) for x in zip(*found)), whole

    def strings(self, sizes: Sequence[int]) -> list[str]:
        packed = [c.astype(t) for c, t in ((self.count, "<i4"), (self.total, "<u8"), (self.check, "<u8"))]
        return [f"{n}:{self.m}:" + base64.b64encode(b"".join(p[i].tobytes() for p in packed)).decode() for i, n in enumerate(sizes)]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The digests of a that b doesn't have, as often as a has them more."""
    keys, n = np.unique(a, return_counts=True)
    theirs, m = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(theirs, keys), max(len(theirs) - 1, 0))
    held = np.where(theirs[at] == keys, m[at], 0) if len(theirs) else np.zeros(len(keys), np.int64)
    return np.repeat(keys, np.maximum(n - held, 0))


def differing(left: Sequence[np.ndarray], right: Sequence[np.ndarray], base: tuple[Sketches, Sketches] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair, the digests that only its left and only its right text has; base: sketches that exist already.

    A pair that doesn't peel is sketched anew in a size for all its digests, which are known, and then in GROW times
    more. After RETRIES its sets are compared as they are: equal digests in one set never peel.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64),) * 2] * len(left)

    def peeled(todo: np.ndarray, a: Sketches, b: Sketches) -> np.ndarray:
        """Those that are left over."""
        row, key, sign, whole = (a - b).peel()
        order = np.argsort(row, kind="stable")
        row, key, sign = row[order], key[order], sign[order]
        ends = np.searchsorted(row, np.arange(len(todo) + 1))
        for r in np.flatnonzero(whole):
            keys, signs = key[ends[r] : ends[r + 1]], sign[ends[r] : ends[r + 1]]
            out[todo[r]] = keys[signs > 0], keys[signs < 0]
        return todo[~whole]

    todo = np.arange(len(left))
    if len(todo):
        todo = peeled(todo, *(base or (Sketches(left, CELLS), Sketches(right, CELLS))))
    wanted = LOAD * np.array([len(left[i]) + len(right[i]) for i in todo])
    steps = np.maximum(1, np.ceil(np.log(np.maximum(wanted, 1) / CELLS) / np.log(GROW))).astype(int)
    for _ in range(RETRIES):
        rest = [(peeled(todo[steps == k], *(Sketches([side[i] for i in todo[steps == k]], CELLS * GROW**k) for side in (left, right))), k) for k in np.unique(steps).tolist()]
        todo = np.concatenate([np.zeros(0, np.int64), *(some for some, _ in rest)])
        steps = np.concatenate([np.zeros(0, np.int64), *(np.full(len(some), k + 1) for some, k in rest)])
    for i in todo.tolist():
        out[i] = _apart(left[i], right[i]), _apart(right[i], left[i])
    return out


def likeness(left: Sequence[np.ndarray], right: Sequence[np.ndarray], base: tuple[Sketches, Sketches] | None = None) -> np.ndarray:
    differ = np.array([len(a) + len(b) for a, b in differing(left, right, base)], float)
    both = np.array([len(a) + len(b) for a, b in zip(left, right)], float)
    return np.where(both + differ > 0, (both - differ) / np.maximum(both + differ, 1), 1.0)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the start of the following text, as long at most."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compare(texts: list[str]) -> pd.DataFrame:
    """A row for each text but the last, which only follows the one before it."""
    texts, following = texts[:-1], texts[1:]
    changed = [edited(t, f) for t, f in zip(texts, following)]
    own, new = ([digests(t) for t in group] for group in ([*texts, following[-1]], changed))
    own, after = own[:-1], own[1:]
    a, b, c = (Sketches(group, CELLS) for group in (own, new, after))
    return pd.DataFrame({
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": a.strings([len(x) for x in own]),
        "edited_fingerprint": b.strings([len(x) for x in new]),
        "near_edited": likeness(own, new, (a, b)),
        "near_next": likeness(own, after, (a, c)),
    })


def in_descending_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket, last): dealt out so that each partition holds a stretch of the descending order, followed
    by the row that comes next, marked `last`.

    Stretches are cut at quantiles of doc_id; texts are shuffled once. Only the cuts and one row's key for each
    stretch pass through the driver: as many as there are partitions.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text")))).first()[0] or 0
    parts = max(1, min(65_536, max(size // BUCKET_BYTES, min(spark.sparkContext.defaultParallelism, size // LEAST_BYTES))))
    cuts = np.zeros(0, np.int64)
    if parts > 1:
        found = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], F.lit(20 * parts))).first()[0]
        cuts = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series((len(cuts) - np.searchsorted(cuts, ids.to_numpy(), side="left")).astype(np.int32))

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("h", F.xxhash64("text")).withColumn("bucket", bucket(F.coalesce("doc_id", F.lit(-(1 << 63)))))
    heads = keyed.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("head")).collect()
    heads.sort(key=lambda r: r["bucket"])
    to = [(heads[i - 1]["bucket"], r["bucket"], r["head"]["doc_id"], r["head"]["h"]) for i, r in enumerate(heads)]
    starts = spark.createDataFrame(to, "to int, bucket int, doc_id long, h long").alias("s")
    follow = keyed.alias("k").join(F.broadcast(starts), F.expr("k.bucket = s.bucket AND k.doc_id <=> s.doc_id AND k.h = s.h"))
    follow = follow.select("k.doc_id", "k.text", "k.h", F.col("s.to").alias("bucket"), F.lit(1).alias("last"))
    rows = keyed.select("doc_id", "text", "h", "bucket", F.lit(0).alias("last")).unionByName(follow)
    return rows.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("last", F.desc_nulls_last("doc_id"), F.desc("h")).select("doc_id", "text", "last")


def fingerprints(docs: DataFrame) -> DataFrame:
    """RESULT for every row: its fingerprint, that of its edited text, and the likenesses to that and to the next row's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        texts: list[str] = []
        held = 0
        ended = False
        for batch in batches:
            for doc_id, text, last in zip(batch["doc_id"], batch["text"], batch["last"]):
                if ended:
                    continue  # repeats of the following row
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
                ended = bool(last)
                if held >= _BATCH_CHARS and len(texts) > 1 or ended:
                    if len(texts) > 1:
                        yield pd.concat([pd.Series(ids[:-1], name="doc_id", dtype=object), compare(texts)], axis=1)
                    ids, texts, held = ids[-1:], texts[-1:], len(text)

    rows = in_descending_order(docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    return rows.mapInPandas(run, RESULT).withColumn("doc_id", F.col("doc_id").cast("long"))
