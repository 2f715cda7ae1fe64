"""Vectorised hashing of the tokens of many texts (NumPy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _classes() -> np.ndarray:
    kinds = np.full(256, 2, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = 0
    kinds[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    return kinds


_KIND = _classes()


def slices(texts: Sequence[str | None], limit: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters each, so that arrays stay small."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def token_hashes(texts: Sequence[str | None], *, lower: bool = True, punctuation: bool = False, prefixes: Sequence[int] = ()) -> tuple[np.ndarray, ...]:
    """(hashes, bounds): tokens of texts[i] are hashes[bounds[i]:bounds[i + 1]].

    For each number in `prefixes`, one more array follows: the hashes of the tokens' first so many bytes.

    A token is a run of letters, digits and non-ASCII bytes; with `punctuation` also a run of other
    visible characters. Null texts have no tokens.
    """
    raw = [((t.lower() if lower else t) if t else "").encode("utf-8", "replace") for t in texts]
    blob = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    starts_of_text = np.concatenate([[0], np.cumsum([len(b) + 1 for b in raw])])
    kind = _KIND[blob]
    if not punctuation:
        kind = np.where(kind == 1, kind, 0)
    inside = kind > 0
    first = inside.copy()
    first[1:] &= kind[1:] != kind[:-1]
    begins = np.flatnonzero(first)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64), *(np.zeros(0, np.uint64) for _ in prefixes)
    at = np.flatnonzero(inside)
    token = np.cumsum(first)[at] - 1
    place = at - begins[token]
    powers = np.multiply.accumulate(np.full(int(place.max()) + 1, _MULT, np.uint64))
    values = (blob[at].astype(np.uint64) + np.uint64(1)) * powers[place]
    heads = np.searchsorted(at, begins)
    hashes = mix(np.add.reduceat(values, heads))
    shorter = (mix(np.add.reduceat(np.where(place < p, values, np.uint64(0)), heads) + np.uint64(p)) for p in prefixes)
    return hashes, np.searchsorted(begins, starts_of_text), *shorter
