"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 7).

A text is split into pieces by the vocabulary's pattern.  A piece is merged by
a priority queue of merge ranks over a doubly linked list of symbols: the best
pair is taken from the heap, entries whose symbols have changed since are stale
and skipped.  Pieces repeat, so each Python worker keeps the ids of the pieces
it has met; the store is emptied when it reaches `MEMO` entries and never
changes a result.  Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 500_000
#: The vocabulary's split pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for ASCII texts, where the faster engine can be used.
ASCII_PATTERN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_UNICODE_PATTERN = regex.compile(PATTERN)


def default_vocabulary() -> str:
    """Where the installed public vocabulary lies; any rank file's path may be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class BytePairEncoder:
    """A vocabulary of byte strings whose ids are also their merge ranks."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.strings = {i: s for s, i in self.ranks.items()}
        self._memo: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, bytes, bytes]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n:
                a, b = symbol[left], symbol[right]
                rank = ranks.get(a + b)
                if rank is not None:
                    heapq.heappush(heap, (rank, left, a, b))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, left, a, b = heapq.heappop(heap)
            right = after[left]
            if right >= n or symbol[left] != a or symbol[right] != b:
                continue  # stale: one of the two has been merged since
            symbol[left], symbol[right] = a + b, None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        ids, i = [], 0
        while i < n:
            ids.append(ranks[symbol[i]])
            i = after[i]
        return tuple(ids)

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.merge(piece.encode("utf-8", "surrogatepass"))
        if len(self._memo) >= MEMO:
            self._memo.clear()
        if len(piece) <= 64:
            self._memo[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for empty and null.  Names of special tokens are ordinary text."""
        if not text:
            return []
        pieces = (ASCII_PATTERN if text.isascii() else _UNICODE_PATTERN).findall(text)
        found = list(map(self._memo.get, pieces))
        if None in found:
            found = [self._piece(p) if x is None else x for p, x in zip(pieces, found, strict=True)]
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=4)
def encoder(path: str) -> BytePairEncoder:
    """One encoder per Python worker and vocabulary."""
    return BytePairEncoder(path)


def token_ids(documents: DataFrame, vocabulary: str | None = None, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`row_id, ids` of every document; an empty list for empty and for null text.

    One pass without a shuffle.  `vocabulary` is the path of a rank file that
    every executor can read.  Repeated rows give a row each.
    """
    path = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                flat: list[int] = []
                ends = [0]
                for t in part.column(1).to_pylist():
                    flat.extend(enc.encode(t))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[row_id, "ids"])

    narrow = documents.select(F.col(f"`{row_id}`").alias(row_id), F.col(f"`{text}`"))
    kind = dict(narrow.dtypes)[row_id]
    return narrow.mapInArrow(encode, f"`{row_id}` {kind}, ids array<int>")


def decoded(tokens: DataFrame, vocabulary: str | None = None, row_id: str = "doc_id") -> DataFrame:
    """`row_id, text` back from the ids."""
    path = vocabulary or default_vocabulary()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = [None if x is None else enc.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[row_id, "text"])

    kind = dict(tokens.dtypes)[row_id]
    return tokens.select(row_id, "ids").mapInArrow(decode, f"`{row_id}` {kind}, text string")
