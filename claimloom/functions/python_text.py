"""Text functions that need Python: full Unicode normalisation, excerpts."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STOP = re.compile(r"[.!?]\s+")
_WORD = re.compile(r"\w+")


def normalized(text: str) -> str:
    """NFKC, casefold, white space runs to one blank, trimmed."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def normalize_for_matching(col: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def apply(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else normalized(x) for x in v.to_pylist()], pa.string())

    return apply(col)


def normalized_text_hash(col: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.sha2(normalize_for_matching(col), 256)


def excerpt(text: str | None, wanted: set[str], limit: int = 320) -> str:
    """The stretch of at most `limit` characters from a sentence start with most wanted words.

    The first of equals wins; without wanted words the text's beginning.
    """
    if not text or len(text) <= limit or not wanted:
        return (text or "")[:limit]
    starts = [0, *(m.end() for m in _STOP.finditer(text))]
    count = [sum(w.casefold() in wanted for w in _WORD.findall(text[a : a + limit])) for a in starts]
    a = starts[count.index(max(count))]
    return text[a : a + limit]


def excerpts(text: Column, wanted: Column, limit: int = 320) -> Column:
    """`wanted` is a column of token arrays, without function words."""

    @F.arrow_udf(T.StringType())
    def apply(t: pa.Array, w: pa.Array) -> pa.Array:
        return pa.array([excerpt(a, set(b or ()), limit) for a, b in zip(t.to_pylist(), w.to_pylist(), strict=True)], pa.string())

    return apply(text, wanted)
