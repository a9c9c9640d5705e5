"""Evaluation texts leaking into training text (problem 8).

Test items are cut into windows of `N` normalised words; their set is broadcast
while it is small (`MAX_GRAMS`, counted first), and each document's word windows
are looked up in it in one pass without a shuffle.  Only inside runs of words
that all occur in test items can a window match, so other windows are never
built.  Windows are compared as whole word sequences: a hit is exact.  A larger
test set is joined by window text instead, both sides distributed; spans are
cut at the joined windows' positions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, fold, is_blank, words

N = 12
MAX_GRAMS = 200_000


class GramIndex:
    """Windows of the test items, as tuples of word numbers."""

    def __init__(self, items: list[tuple[int, str | None]], n: int) -> None:
        self.n = n
        self.number: dict[str, int] = {}
        self.items: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            seq = [self.number.setdefault(w, len(self.number)) for w in words(text or "")]
            for i in range(len(seq) - n + 1):
                self.items.setdefault(tuple(seq[i : i + n]), set()).add(item)

    def hits(self, ws: list[str]) -> Iterator[tuple[int, set[int]]]:
        """Positions of matching windows with their items."""
        n, get = self.n, self.number.get
        seq = [get(w, -1) for w in ws]
        start = 0
        while start < len(seq):
            try:
                stop = seq.index(-1, start)
            except ValueError:
                stop = len(seq)
            for i in range(start, stop - n + 1):
                found = self.items.get(tuple(seq[i : i + n]))
                if found:
                    yield i, found
            start = stop + 1


def _pairs_broadcast(documents: DataFrame, index: GramIndex) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            ids, items = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found: set[int] = set()
                for _, s in ix.hits(words(t or "")):
                    found |= s
                ids += [d] * len(found)
                items += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

    return documents.mapInArrow(scan, "doc_id bigint, item_id bigint")


def _windows(rows: DataFrame, n: int, name: str) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, grams = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(t or "")
                own = {" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)}
                ids += [d] * len(own)
                grams += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.string())], names=[name, "gram"])

    return rows.mapInArrow(cut, f"{name} bigint, gram string")


def leaked_items(documents: DataFrame, benchmark: DataFrame, n: int = N, max_grams: int = MAX_GRAMS) -> DataFrame:
    """`doc_id, item_id`, once each: the document holds at least `n` consecutive words of the item.

    Words are runs of letters and digits after NFKC without case, so white
    space, punctuation, line breaks and diff marks between them don't matter.
    Items and documents with fewer than `n` words, null and empty texts give
    no row; repeated rows of a document give one.
    """
    docs = documents.select(F.col("doc_id").cast("bigint"), "text")
    items = _items(benchmark)
    index = _small_index(items, n, max_grams)
    if index is not None:
        return _pairs_broadcast(docs, index).dropDuplicates(["doc_id", "item_id"])
    return _windows(docs, n, "doc_id").join(_windows(items, n, "item_id"), "gram").select("doc_id", "item_id").distinct()


def _items(benchmark: DataFrame) -> DataFrame:
    """The test items that hold any text."""
    return benchmark.select(F.col("item_id").cast("bigint"), "text").where(~is_blank(F.col("text")))


def _small_index(items: DataFrame, n: int, max_grams: int) -> GramIndex | None:
    """The index of all items where it fits the broadcast bound, counted before anything is collected; else None."""
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > max_grams * 8:  # a window starts at a word, of one letter and one separator at least
        return None
    index = GramIndex([(r[0], r[1]) for r in items.collect()], n)  # no item is blank, so characters bound the rows too
    return index if len(index.items) <= max_grams else None


def without_leaks(documents: DataFrame, benchmark: DataFrame, n: int = N, max_grams: int = MAX_GRAMS) -> DataFrame:
    """`doc_id, text, removed_words`: leaked spans cut out of the documents that have any.

    A span reaches from the first letter of its first word to the last of its
    last; overlapping spans are cut as one.  A test set beyond the broadcast
    bound is joined by window text with the positions of each document's windows.
    """
    docs = documents.select(F.col("doc_id").cast("bigint"), "text")
    items = _items(benchmark)
    index = _small_index(items, n, max_grams)
    if index is not None:
        return _cut_broadcast(docs, index, n)
    docs = docs.withColumn("digest", F.sha2("text", 256))
    grams = _windows(items, n, "item_id").select("gram").distinct()
    hits = _placed_windows(docs, n).join(grams, "gram").groupBy("doc_id", "digest").agg(F.collect_set("at").alias("hits"))
    # Rows of one id and text have the same hits; a null id is an id as well.
    same = docs["digest"].eqNullSafe(hits["digest"]) & docs["doc_id"].eqNullSafe(hits["doc_id"])
    return _cut_at(docs.join(hits, same).select(docs["doc_id"], "text", "hits"), n)


_CUT = "doc_id bigint, text string, removed_words int"


def _cut_broadcast(docs: DataFrame, index: GramIndex, n: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            yield _cleaned([(d, t, [i for i, _ in ix.hits(words(t or ""))]) for d, t in rows], n)

    return docs.mapInArrow(cut, _CUT)


def _cut_at(rows: DataFrame, n: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _cleaned(list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)), n)

    return rows.mapInArrow(cut, _CUT)


def _placed_windows(docs: DataFrame, n: int) -> DataFrame:
    """`doc_id, digest, at, gram`: each window with the number of its first word."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):  # a batch's windows at once could fill the memory
            ids, digests, places, grams = [], [], [], []
            for d, t, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ws = words(t or "")
                k = max(0, len(ws) - n + 1)
                ids += [d] * k
                digests += [h] * k
                places += range(k)
                grams += [" ".join(ws[i : i + n]) for i in range(k)]
            arrays = [pa.array(ids, pa.int64()), pa.array(digests, pa.string()), pa.array(places, pa.int32()), pa.array(grams, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "digest", "at", "gram"])

    return docs.select("doc_id", "text", "digest").mapInArrow(cut, "doc_id bigint, digest string, at int, gram string")


def _cleaned(rows: list[tuple[int, str | None, list[int]]], n: int) -> pa.RecordBatch:
    """The rows with any hits (first words of matching windows), without the words of those windows."""
    ids, texts, removed = [], [], []
    for d, t, hits in rows:
        if not hits:
            continue
        marks = _spans(t)
        gone = bytearray(len(marks))
        for i in hits:
            gone[i : i + n] = b"\x01" * n
        out, at, i = [], 0, 0
        while i < len(gone):
            if gone[i]:
                j = i
                while j < len(gone) and gone[j]:
                    j += 1
                out.append(t[at : marks[i][1]])
                at, i = marks[j - 1][2], j
            else:
                i += 1
        out.append(t[at:])
        ids.append(d)
        texts.append("".join(out))
        removed.append(sum(gone))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["doc_id", "text", "removed_words"])


def _spans(text: str) -> list[tuple[str, int, int]]:
    """Words with the stretch of the stored text each comes from."""
    if text.isascii():
        return [(m.group(), m.start(), m.end()) for m in WORD.finditer(text.lower())]
    folded, first, last, at = [], [], [], 0
    for unit in _units(text):
        f = fold(unit)
        folded.append(f)
        first += [at] * len(f)
        at += len(unit)
        last += [at] * len(f)
    return [(m.group(), first[m.start()], last[m.end() - 1]) for m in WORD.finditer("".join(folded))]


def _units(text: str) -> Iterator[str]:
    """Shortest pieces that normalise each by itself as they do in the whole text: a character with all that joins it."""
    start = 0
    for i in range(1, len(text)):
        if text[i] < "\x80" or not _joins(text[i]):
            yield text[start:i]
            start = i
    if text:
        yield text[start:]


@cache
def _joins(ch: str) -> bool:
    """Whether normalisation may move or compose the character with those before it."""
    first = unicodedata.normalize("NFKD", ch)[0]
    return unicodedata.combining(first) > 0 or first in _seconds()


@cache
def _seconds() -> frozenset[str]:
    """Characters that are the second half of a composed one, Hangul vowels and finals included."""
    halves = (unicodedata.decomposition(chr(c)).split() for c in range(0x30000))
    found = {chr(int(h[1], 16)) for h in halves if len(h) == 2 and not h[0].startswith("<")}
    return frozenset(found) | set(map(chr, range(0x1161, 0x1176))) | set(map(chr, range(0x11A8, 0x11C3)))
