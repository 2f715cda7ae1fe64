"""Language identification by unigrams of subword pieces, summed over all segmentations.

A text is its words: longest runs of letters with their marks, in lower case, each begun by the mark U+2581. A word's
symbols are its characters, or the UTF-8 bytes of those that are no piece of the vocabulary. The vocabulary is fixed
and public, a sentencepiece file; each language has a probability for every piece. A forward pass over a word adds up
the probabilities of all ways to cut it into pieces: its probability in that language. A text's is the product over
its words, and the prediction is the language in which it is largest, languages being equally likely beforehand.

Piece probabilities are learned by expectation maximisation from the counts of all words of the labelled texts: a
forward and a backward pass over each distinct word give the expected number of every piece. Counting words is one
shuffle of sums; each round reads the distinct words alone and returns at most a sum for each language and piece. A
language's probabilities are mixed with those of all together, so a piece that it lacks says little, not everything.

Defined cases: a text that is null or has no letter is `und` with score 0, and so are all texts if nothing was learned.
A language all of whose texts lack letters isn't learned; an empty string is a language like another. Ties go to the
least name. Runs of over LONGEST symbols are cut there, so that a word's work is bounded; all their parts count.
Repeated rows count each. A null doc_id is neither learned from nor held out. An empty table gives an empty result. Extra
columns aren't read. More than MAX_LANGUAGES languages raise: a model holds a probability for each piece of each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.runs import framed
from loomtext.llm.tokens import mix, slices
from loomtext.session import pinned, spread, unpinned

ROUNDS = 4
LONGEST = 32
MAX_LANGUAGES = 512
#: Share of a language's probabilities that those of all languages together make up, and of these that is uniform.
POOLED, UNIFORM = 0.05, 0.01
#: Probabilities are multiplied by this for each symbol, so that a word's stay in the range of doubles.
_LIFT = 1024.0
_CACHED_CELLS = 1 << 20
_FLUSH, _SLICE = 200_000, 1 << 20
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_BEGIN = "▁"
_BYTE = 0x200000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The pieces of a sentencepiece vocabulary that words can be cut into, to be looked up by their symbols."""

    def __init__(self, model: bytes):
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        symbols: dict[tuple[int, ...], str] = {}
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                symbols[(_BYTE + int(piece[3:5], 16),)] = piece
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i) or _BEGIN in piece[1:]):
                symbols[tuple(map(ord, piece))] = piece
        for byte in range(256):
            symbols.setdefault((_BYTE + byte,), f"<0x{byte:02X}>")
        symbols.setdefault((ord(_BEGIN),), _BEGIN)
        self.texts = list(symbols.values())
        self.known = {chr(s[0]) for s in symbols if len(s) == 1 and s[0] < _BYTE}
        self.is_known = np.zeros(0x110000, bool)
        self.is_known[[ord(c) for c in self.known]] = True
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, min(LONGEST, max(map(len, symbols))) + 1):
            some = [(i, s) for i, s in enumerate(symbols) if len(s) == n]
            codes = self._hash(np.array([s for _, s in some], np.int64).reshape(-1, n))
            order = np.argsort(codes)
            self.tables.append((codes[order], np.array([i for i, _ in some], np.int64)[order]))

    def __len__(self) -> int:
        return len(self.texts)

    @staticmethod
    def _hash(symbols: np.ndarray) -> np.ndarray:
        """One number for each row; rows of one length."""
        h = np.zeros(symbols.shape[:-1], np.uint64)
        for k in range(symbols.shape[-1]):
            h = mix(h * _STEP + symbols[..., k].astype(np.uint64) + np.uint64(1))
        return h

    def parts(self, word: str) -> list[list[int]]:
        """A word's symbols, in stretches of at most LONGEST."""
        out: list[int] = [ord(_BEGIN)]
        for c in word:
            if c in self.known:
                out.append(ord(c))
            else:
                out.extend(_BYTE + b for b in c.encode("utf-8", "replace"))
        return [out[i : i + LONGEST] for i in range(0, len(out), LONGEST)]

    def at(self, symbols: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(end, length, piece) for every place in the rows of `symbols` where a piece may end, by end; piece is
        len(self) where there is none."""
        n = symbols.shape[1]
        found: dict[tuple[int, int], np.ndarray] = {}
        h = np.zeros(symbols.shape, np.uint64)
        for length, (codes, ids) in enumerate(self.tables[:n], 1):
            h = mix(h[:, : n - length + 1] * _STEP + symbols[:, length - 1 :].astype(np.uint64) + np.uint64(1))
            if len(codes):
                place = np.minimum(np.searchsorted(codes, h), len(codes) - 1)
                piece = np.where(codes[place] == h, ids[place], len(self))
                for start in np.flatnonzero((piece < len(self)).any(axis=0)).tolist():
                    found[start + length, length] = piece[:, start]
        for end, length in sorted(found):
            yield end, length, found[end, length]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _by_length(pieces: Pieces, words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words, symbols) of the words' parts of one length, a part each row."""
    lengths = np.array([len(w) for w in words], np.int64)
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for n in np.unique(lengths).tolist():
        owner = np.flatnonzero(lengths == n)
        codes = np.frombuffer("".join([words[i] for i in owner.tolist()]).encode("utf-32-le", "replace"), "<u4").reshape(-1, n).astype(np.int64)
        plain = pieces.is_known[codes].all(axis=1) if n < LONGEST else np.zeros(len(owner), bool)
        if plain.any():
            parts.setdefault(n + 1, []).append((owner[plain], np.insert(codes[plain], 0, ord(_BEGIN), axis=1)))
        for i in owner[~plain].tolist():
            for part in pieces.parts(words[i]):
                parts.setdefault(len(part), []).append((np.array([i]), np.array([part], np.int64)))
    for found in parts.values():
        owner, symbols = (np.concatenate(x) for x in zip(*found))
        for k in range(0, len(owner), 8192):
            yield owner[k : k + 8192], symbols[k : k + 8192]


class LanguageModel:
    """Probabilities of pieces (rows; the last, of no piece, is 0) by language (columns, in the order of names)."""

    def __init__(self, pieces: Pieces, names: Sequence[str], p: np.ndarray):
        self.pieces, self.names = pieces, list(names)
        self.p = np.concatenate([p, np.zeros((1, p.shape[1]))])

    def log_likelihood(self, words: Sequence[str]) -> np.ndarray:
        """Each word's log probability in each language, over all segmentations."""
        out = np.zeros((len(words), len(self.names)))
        for owner, symbols in _by_length(self.pieces, words):
            n = symbols.shape[1]
            forward = np.zeros((n + 1, len(symbols), len(self.names)))
            forward[0] = 1.0
            for end, length, piece in self.pieces.at(symbols):
                forward[end] += forward[end - length] * (self.p[piece] * _LIFT**length)
            np.add.at(out, owner, np.log(forward[n]) - n * np.log(_LIFT))
        return out

    def expected(self, words: Sequence[str], counts: np.ndarray, language: np.ndarray) -> np.ndarray:
        """The expected number of every piece by language, of words with their counts in one language each."""
        k = len(self.names)
        cells, amounts = [np.zeros(0, np.int64)], [np.zeros(0)]
        flat = self.p.ravel()
        for owner, symbols in _by_length(self.pieces, words):
            n, own = symbols.shape[1], language[owner]
            steps = [(end, length, piece, flat[piece * k + own] * _LIFT**length) for end, length, piece in self.pieces.at(symbols)]
            forward, backward = np.zeros((n + 1, len(symbols))), np.zeros((n + 1, len(symbols)))
            forward[0] = backward[n] = 1.0
            for end, length, _, p in steps:
                forward[end] += forward[end - length] * p
            for end, length, _, p in reversed(steps):
                backward[end - length] += backward[end] * p
            share = counts[owner] / forward[n]
            for end, length, piece, p in steps:
                held = piece < len(self.pieces)
                cells.append(piece[held] * k + own[held])
                amounts.append((forward[end - length] * p * backward[end] * share)[held])
        return np.bincount(np.concatenate(cells), np.concatenate(amounts), minlength=len(self.pieces) * k).reshape(-1, k)


def mixed(expected: np.ndarray) -> np.ndarray:
    """Probabilities from expected numbers of pieces (rows) by language (columns)."""
    pooled = expected.sum(axis=1)
    pooled = (1 - UNIFORM) * pooled / max(pooled.sum(), 1e-300) + UNIFORM / len(pooled)
    own = expected / np.maximum(expected.sum(axis=0), 1e-300)
    return (1 - POOLED) * own + POOLED * pooled[:, None]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over whole texts; a task adds up what it reads before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def rows() -> Iterator[pd.DataFrame]:
            for lang, found in ((k, c) for k, c in held.items() if c):
                yield pd.DataFrame({"lang": lang, "word": list(found), "n": list(found.values())})
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > _FLUSH:
                yield from rows()
        yield from rows()

    return docs.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, vocabulary: bytes, *, rounds: int = ROUNDS) -> LanguageModel | None:
    """The model of docs (text, lang), all of whose rows with a lang are learned from; None if they have no word."""
    words = spread(pinned(word_counts(docs.where("lang IS NOT NULL AND text IS NOT NULL")), "words"))
    names = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names.sort()
    if not names:
        unpinned(words)
        return None
    pieces = Pieces(vocabulary)
    model = LanguageModel(pieces, names, np.full((len(pieces), len(names)), 1 / len(pieces)))
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = shared.value  # noqa: B023
            place = {name: i for i, name in enumerate(model.names)}
            sums = np.zeros((len(model.pieces), len(model.names)))
            for batch in framed(batches, _FLUSH // 4):
                sums += model.expected(batch["word"].tolist(), batch["n"].to_numpy(float), batch["lang"].map(place).to_numpy(np.int64))
            piece, lang = np.nonzero(sums)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": sums[piece, lang]})

        found = words.mapInPandas(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        sums = np.zeros((len(pieces), len(names)))
        sums[found["piece"], found["lang"]] = found["n"]
        model = LanguageModel(pieces, names, mixed(sums))
        shared.unpersist()
    unpinned(words)
    return model


class Scorer:
    """Log probabilities of texts, with those of words that were met kept up to a bound."""

    def __init__(self, model: LanguageModel):
        self.model, self.k = model, len(model.names)
        self.size = max(4096, _CACHED_CELLS // self.k)
        self.place: dict[str, int] = {}
        self.held = np.zeros((self.size, self.k))

    def _places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, table): each word's row in the table."""
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if len(self.place) + len(new) > self.size:
            self.place.clear()
            new = list(dict.fromkeys(words))
        values = self.model.log_likelihood(new)
        if len(new) > self.size:
            place = {w: i for i, w in enumerate(new)}
            return np.array([place[w] for w in words], np.int64), values
        first = len(self.place)
        self.held[first : first + len(new)] = values
        self.place.update(zip(new, range(first, first + len(new))))
        return np.array([self.place[w] for w in words], np.int64), self.held

    def predict(self, texts: Sequence[str | None]) -> Iterator[tuple[str, float]]:
        for i, j in slices(texts, _SLICE):
            words = [words_of(t) for t in texts[i:j]]
            lengths = np.array([len(w) for w in words])
            rows, table = self._places([w for some in words for w in some])
            owner = np.repeat(np.arange(j - i), lengths)
            total = np.stack([np.bincount(owner, table[rows, k], minlength=j - i) for k in range(self.k)], axis=1)
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            yield from (("und", 0.0) if not n else (self.model.names[b], float(p)) for n, b, p in zip(lengths, best, share))


def predicted(model: LanguageModel | None, text: Column | str) -> Column:
    """struct<lang_pred, score> of a text column; score is the language's share of the probability of all."""
    if model is None:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            yield pd.DataFrame(list(scorer.predict(batch.tolist())), columns=["lang_pred", "score"])

    return predict(text)


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is in the fold that isn't learned from; false of a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))
