"""Byte-level BPE by a sentencepiece model that is serialised from a rank file.

Each byte becomes one character (U+0100 + byte), each ranked byte string a piece of such characters with score
-rank, so sentencepiece's best-score-first merges are the rank file's lowest-rank-first merges. Normalisation
is the identity. A text is split by the vocabulary's pattern, with letters and numbers as tiktoken's tables have them; each pre-token is one piece if it is ranked as it
stands, else sentencepiece encodes it. Decoding maps ids back to bytes.

Defined cases: a null or empty text has no ids, and no ids decode to no bytes; a null list of ids decodes like an
empty one; an unknown id raises. Special strings are ordinary text. Other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CACHE_PIECES = 150_000
_AS_CHARS = {b: chr(0x100 + b) for b in range(256)}
_WORKER: dict[str, Codec] = {}


_LETTER_OR_NUMBER = regex.compile(r"[\p{L}\p{N}]")
_NEITHER = "\u0378"  # unassigned in every version of Unicode


@lru_cache
def _class_tables() -> list[tiktoken.Encoding]:
    """Encodings that find only letters, and only numbers, by tiktoken's own character tables."""
    single = {bytes([b]): b for b in range(256)}
    return [tiktoken.Encoding(f"only {c}", pat_str=rf"\p{{{c}}}", mergeable_ranks=single, special_tokens={}) for c in "LN"]


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, an integer or a 32-bit float."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece numbers are the ranks; the unknown piece comes last.

    Fixed values: the field numbers of sentencepiece_model.proto. Pieces (1) have text 1, score 2, type 3 (2:
    unknown); the trainer spec (2) has model_type 3 (2: BPE), vocab_size 4, unk_id 40, bos, eos and pad ids 41 to 43;
    the normaliser spec (3) has name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    pieces = [_field(1, "".join(map(_AS_CHARS.__getitem__, t)).encode()) + _field(2, -float(rank)) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    none = (1 << 64) - 1  # -1
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, none) + _field(42, none) + _field(43, none)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec(dict):
    """ids by pre-token, for one rank file and split pattern; filled as pre-tokens come up."""

    def __init__(self, content: bytes, pattern: str):
        import sentencepiece

        super().__init__()
        self.ranks = read_ranks(content)
        self.pieces = [b""] * len(self.ranks)
        for token, rank in self.ranks.items():
            self.pieces[rank] = token
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.split = regex.compile(pattern)
        self.settled = set(map(chr, range(128)))
        self.shadow: dict[str, str] = {}
        self.numbers = list(range(len(self.pieces) + 1))  # cached ids share these objects

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        rank = self.ranks.get(raw)
        ids = (rank,) if rank is not None else tuple(map(self.numbers.__getitem__, self.model.encode("".join(map(_AS_CHARS.__getitem__, raw)), num_threads=1)))
        if len(self) >= CACHE_PIECES:
            self.clear()
        if len(piece) <= 100:
            self[piece] = ids
        return ids

    def pre_tokens(self, text: str) -> list[str]:
        """Characters that the splitter's newer tables may class otherwise are split as ones of their class in tiktoken's."""
        if not text.isascii() and not self.settled.issuperset(text):
            for c in set(text) - self.settled - self.shadow.keys():
                if bool(_LETTER_OR_NUMBER.match(c)) == (unicodedata.category(c)[0] in "LN"):
                    self.settled.add(c)
                else:
                    letter, number = (bool(t.encode_ordinary(c)) for t in _class_tables())
                    self.shadow[c] = "a" if letter else "1" if number else _NEITHER
            if any(map(text.__contains__, self.shadow)):
                changed = text.translate(str.maketrans(self.shadow))
                return [text[m.start() : m.end()] for m in self.split.finditer(changed)]
        return self.split.findall(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pre_tokens(text)))) if text else []

    def decode(self, ids: list[int] | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids)) if ids else b""

    def encode_all(self, texts: pa.Array) -> tuple[pa.Array, list[list[int]]]:
        found = [self.encode(t) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]))
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), found


def worker_codec(content: bytes, pattern: str) -> Codec:
    key = hashlib.md5(content + pattern.encode()).hexdigest()
    if key not in _WORKER:
        _WORKER[key] = Codec(content, pattern)
    return _WORKER[key]


class ByteBPE:
    """Encoder and decoder columns for the content of a rank file and its split pattern."""

    def __init__(self, spark: SparkSession, content: bytes, pattern: str):
        self.shared = spark.sparkContext.broadcast((content, pattern))

    def encode(self, text: Column) -> Column:
        """array<int>: the ids of a text column."""
        shared = self.shared

        @F.arrow_udf("array<int>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = worker_codec(*shared.value)
            for batch in batches:
                yield codec.encode_all(batch)[0]

        return encode(text)

    def decode(self, ids: Column) -> Column:
        """binary: the bytes of the ids; cast to string where they are known to be valid UTF-8."""
        shared = self.shared

        @F.arrow_udf("binary")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = worker_codec(*shared.value)
            for batch in batches:
                yield pa.array([codec.decode(i) for i in batch.to_pylist()], pa.binary())

        return decode(ids)

    def round_trip(self, text: Column) -> Column:
        """struct<ids: array<int>, decoded: binary>: both ways in one Python worker, decoded from the ids."""
        shared = self.shared

        @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
        def there_and_back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = worker_codec(*shared.value)
            for batch in batches:
                ids, found = codec.encode_all(batch)
                yield pa.StructArray.from_arrays([ids, pa.array(map(codec.decode, found), pa.binary())], ["ids", "decoded"])

        return there_and_back(text)
