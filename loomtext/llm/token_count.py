"""Token counts by a two-tier lookup of pre-tokens, without shuffling any text or pre-token of the corpus.

Tier one is a compact table of the lengths, in tokens, of pre-tokens that are frequent in a bounded sample;
it is broadcast and seeds each worker's table. Tier two is the rest of that table, a bounded cache: pre-tokens that
tier one misses are encoded by the library once for each worker. When the cache is full, only tier one stays. The
tables only save work: a count never depends on what they hold.

Special strings in a text are found first, as the library does by default, and count as one token each.
Where the library's older character tables might split a text otherwise, it encodes the whole text itself.

Defined cases: a null or empty text has 0 tokens. Repeated rows get equal counts. An empty table has no counts and an
empty tier one. The operator is a column, so other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_PIECES = 50_000
SAMPLE_DOCS = 2_000
CACHE_PIECES = 300_000
_LETTER_OR_NUMBER = regex.compile(r"[\p{L}\p{N}]")
_WORKER: dict[str, PieceLengths] = {}


class PieceLengths(dict):
    """Token counts by pre-token; a missing one is encoded and, unless it is long, remembered."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_str(vocabulary)
        self.split = regex.compile(public_tokenizers.PATTERN)
        specials = [t["content"] for t in json.loads(vocabulary).get("added_tokens", []) if t["content"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.settled: set[str] = set(map(chr, range(128)))
        self.hot: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        n = len(self.library.encode(piece, add_special_tokens=False).ids)
        if len(self) >= CACHE_PIECES + len(self.hot):
            self.clear()
            self.update(self.hot)
        if len(piece) <= 100:
            self[piece] = n
        return n

    def seed(self, hot: dict[str, int]) -> None:
        if hot is not self.hot:
            self.hot = hot
            self.update(hot)

    def known(self, text: str) -> bool:
        """Whether all characters are of the same class in this Python's, the splitter's and so the library's tables."""
        if text.isascii() or self.settled.issuperset(text):
            return True
        new = set(text) - self.settled
        self.settled |= {c for c in new if bool(_LETTER_OR_NUMBER.match(c)) == (unicodedata.category(c)[0] in "LN")}
        return self.settled.issuperset(new)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.known(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.split.findall(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.split.findall(p))) for p in parts)


def worker_lengths(vocabulary: str, hot: dict[str, int] | None) -> PieceLengths:
    """This worker's cache for a vocabulary: kept from task to task."""
    key = hashlib.md5(vocabulary.encode()).hexdigest()
    if key not in _WORKER:
        _WORKER[key] = PieceLengths(vocabulary)
    if hot:
        _WORKER[key].seed(hot)
    return _WORKER[key]


def frequent_lengths(docs: DataFrame, vocabulary: str, *, pieces: int = HOT_PIECES, sample_docs: int = SAMPLE_DOCS, seed: int = 3) -> dict[str, int]:
    """Tier one: lengths of the most frequent pre-tokens of a random sample of about `sample_docs` texts."""

    def pieces_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = regex.compile(public_tokenizers.PATTERN)
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(p for p in split.findall(text) if len(p) <= 100)
        lengths = worker_lengths(vocabulary, None)
        yield pd.DataFrame([(p, lengths[p]) for p, n in seen.most_common(pieces)], columns=["piece", "n"])

    texts = docs.select("text").where("text IS NOT NULL")
    sample = texts.sample(min(1.0, sample_docs / max(1, texts.count())), seed)
    table = sample.repartition(1).mapInPandas(pieces_of, "piece string, n int").toPandas()
    return dict(zip(table["piece"], table["n"].astype(int)))


def token_count(docs: DataFrame, text: Column, vocabulary: str, **options) -> Column:
    """Column: the library's token count of each text, by the vocabulary file's content."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, frequent_lengths(docs, vocabulary, **options)))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = worker_lengths(*shared.value)
        for batch in batches:
            yield pd.Series([lengths.count(t) for t in batch], dtype="int64")

    return count(text)
