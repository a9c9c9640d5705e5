"""Letters-and-digits comparison keys.

Spark has no Unicode normalisation builtin, so NFKC runs in one Arrow UDF per
projection; ASCII values take a short path inside it.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NOT_ALNUM = re.compile(r"[\W_]+")
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """NFKC and casefold, the form in which texts are compared."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text).casefold()


def alnum_only(text: str | None) -> str | None:
    """Letters and digits of a text in their order, folded; null stays null."""
    return None if text is None else _NOT_ALNUM.sub("", fold(text))


def words(text: str) -> list[str]:
    """Longest runs of letters and digits of the folded text."""
    return WORD.findall(fold(text))


def alnum_key(col: Column) -> Column:
    """`alnum_only` as a column. Null gives null, a value without letters or digits ''."""

    @F.arrow_udf(T.StringType())
    def key(values: pa.Array) -> pa.Array:
        memo: dict[str | None, str | None] = {}
        out = []
        for v in values.to_pylist():
            if v not in memo:
                if len(memo) > 50_000:
                    memo.clear()
                memo[v] = alnum_only(v)
            out.append(memo[v])
        return pa.array(out, pa.string())

    return key(col)


def is_blank(col: Column) -> Column:
    """True for null, empty, or white space only (Unicode white space included)."""
    return col.isNull() | ~col.rlike(r"(?U)\S")


def none_if_blank(col: Column) -> Column:
    return F.when(~is_blank(col), col)
