"""Token, shingle and fingerprint expressions; all but the similarity hash stay inside the JVM."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Function words left out when contents are matched (fixed values).
MATCH_STOPS = (
    "yang dan di ke dari pada untuk dengan ini itu adalah akan atau sebagai oleh dalam juga telah "
    "the a an of to in on for and or is are was were be been as by with that this at"
).split()
# Function words left out when queries are planned (fixed values).
PLAN_STOPS = "yang dan di ke dari pada untuk dengan adalah itu ini para sebuah the a an of in on at and to for with is are was were".split()

_TOKEN = r"[\p{L}\p{N}_]+"


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """How many tokens a text has, without making them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_TOKEN))


def search_tokens(text: Column) -> Column:
    """Tokens in lower case, as the search index has them (B1)."""
    return F.transform(raw_tokens(text), F.lower)


def match_tokens(text: Column) -> Column:
    """Tokens case-folded for matching (B2): lower case, and ss for the sharp s."""
    return F.transform(raw_tokens(text), lambda x: F.replace(F.lower(x), F.lit("ß"), F.lit("ss")))


def content_tokens(text: Column) -> Column:
    """Matching tokens without function words."""
    stops = F.array(*map(F.lit, MATCH_STOPS))
    return F.filter(match_tokens(text), lambda x: ~F.array_contains(stops, x))


def shingles(tokens: Column, n: int) -> Column:
    """Overlapping runs of `n` tokens (B6); all tokens as one run where there are fewer; none for none."""
    if n < 1:
        raise ValueError("a shingle has at least one token")

    def runs(t: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, F.lit(n)), " "))
        return F.when(F.size(t) >= n, cut).when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))

    # Bound by a lambda, the tokens are made once per row and not once per run.
    return F.transform(F.array(tokens), runs)[0]


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets (B9); 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sha256_64(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:8]


def blake2_64(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


def simhash(df: DataFrame, key: str, shingle_list: str, digest: Callable[[bytes], bytes] = sha256_64) -> DataFrame:
    """`key, hi, lo`: the 64-bit similarity hash of each row's shingles, counted with repeats.

    Bits come from the 8 bytes of `digest`, in two halves of 32; a bit is
    set where more shingles have it than not.  Rows without shingles have both
    halves 0.  One Arrow pass: 64 sums over exploded rows would outgrow the
    size that generated code may have.
    """

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = []
            for runs in b.column(1).to_pylist():
                value = 0
                if runs:
                    digests = b"".join([digest(s.encode("utf-8", "surrogatepass")) for s in runs])
                    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
                    value = int.from_bytes(np.packbits(bits * 2 > len(runs)).tobytes(), "big")
                values.append(value)
            halves = [pa.array([v >> 32 for v in values], pa.int64()), pa.array([v & 0xFFFFFFFF for v in values], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *halves], names=[key, "hi", "lo"])

    narrow = df.select(key, shingle_list)
    return narrow.mapInArrow(votes, f"`{key}` {dict(narrow.dtypes)[key]}, hi bigint, lo bigint")
