"""Token ids as strings: the k-th character's code point is the k-th id. Ids stay below 55,296 (surrogates)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ID = 55_295
#: Each merge nests one more call in the plan; longer tables take operators.bpe.Codec.
MAX_FOLDED = 64


def _foldable(merges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if len(merges) > MAX_FOLDED:
        raise ValueError(f"{len(merges)} merges are over the {MAX_FOLDED} that a plan can nest")
    return merges


def byte_string(text: Column) -> Column:
    """A text's UTF-8 bytes, one character for each."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def id_string(ids: Column) -> Column:
    """The string of an id array."""
    return F.array_join(F.transform(ids, lambda i: F.decode(F.unhex(F.lpad(F.hex(i), 4, "0")), "UTF-16BE")), "")


def ids_of(string: Column) -> Column:
    return F.transform(F.filter(F.split(string, ""), lambda c: c != ""), F.ascii)


def utf8_ids(text: Column) -> Column:
    """array<int> of 0..255; an empty text has none, a null text null."""
    return ids_of(byte_string(text))


def pairs_of(ids: Column) -> Column:
    """Adjacent pairs (a, b) of an id array; none of fewer than two ids."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.zip_with(F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def merge_pair(string: Column, a: int, b: int, new: int) -> Column:
    """Every occurrence of the pair as the new id, left to right without overlaps."""
    return F.replace(string, F.lit(chr(a) + chr(b)), F.lit(chr(new)))


def encode_string(string: Column, merges: list[tuple[int, int, int]]) -> Column:
    """Merges (a, b, id) in rank order: a merge only makes pairs of later ranks, so one pass is enough."""
    for a, b, new in _foldable(merges):
        string = merge_pair(string, a, b, new)
    return string


def decode_string(string: Column, merges: list[tuple[int, int, int]]) -> Column:
    """Text of an encoded string, by the merges in reverse; invalid UTF-8 becomes U+FFFD. Unknown ids raise."""
    top = 255 + len(merges)
    checked = F.when(F.exists(ids_of(string), lambda i: i > top), F.raise_error(F.lit(f"a token id is above {top}"))).otherwise(string)
    for a, b, new in reversed(_foldable(merges)):
        checked = F.replace(checked, F.lit(chr(new)), F.lit(chr(a) + chr(b)))
    return F.make_valid_utf8(F.encode(checked, "ISO-8859-1").cast("string"))
