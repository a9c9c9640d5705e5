"""Duplicates hidden by formatting differences (problem 5).

A record's canonical form is the letters and digits of its text (NFKC, case
folded) and the canonical form of its address (parameters in sorted order).  It
is hashed to 128 bits; counts are aggregated with map-side combining, so a form
that a third of all rows share costs one row per map task.  A second,
independent 64-bit hash, seeded with the length, travels along as min and max:
where they differ within one group two forms collided, and those groups alone are
split by the second hash.  Members are listed by a join with the few groups of
two and more; a hot group's members are split over tasks by the skew join of
adaptive execution, since the group's side is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum_only
from ..functions.urls import canonical
from ..session import written

_SCHEMA = "row_id bigint, h1 bigint, h2 bigint, check bigint"


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, h1, h2, check = [], [], [], []
        for i, text, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if text is None or not text.strip():
                continue
            blank = url is None or not url.strip()
            # An address without a canonical form is compared as it is written.
            address = "" if blank else canonical(url) or "\x02" + url.strip()
            form = f"{alnum_only(text)}\x01{address}".encode("utf-8", "surrogatepass")
            h = xxhash.xxh3_128_intdigest(form)
            ids.append(i)
            h1.append(_signed(h >> 64))
            h2.append(_signed(h & (1 << 64) - 1))
            check.append(_signed(xxhash.xxh64_intdigest(form, seed=len(form))))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, h1, h2, check)], names=["row_id", "h1", "h2", "check"])


def fingerprints(records: DataFrame, row_id: str = "rec_id", text: str = "text", url: str = "url") -> DataFrame:
    """`row_id, h1, h2, check` of each record whose text isn't blank, written once."""
    narrow = records.select(F.col(f"`{row_id}`").cast("bigint"), F.col(f"`{text}`"), F.col(f"`{url}`"))
    return written(narrow.mapInArrow(_hashes, _SCHEMA), "copies")


def _groups(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of equal form and, apart, those of collided hashes."""
    g = marks.groupBy("h1", "h2").agg(
        F.min("row_id").alias("keep"), F.count("*").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi")
    )
    clean = g.where("lo = hi").select("h1", "h2", "keep", "n")
    bad = g.where("lo <> hi").select("h1", "h2")
    split = marks.join(bad, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "check").agg(F.min("row_id").alias("keep"), F.count("*").alias("n"))
    return clean, split


def copy_rows(marks: DataFrame) -> DataFrame:
    """`keep_rec_id, copy_rec_id`: one row for each member of a set but its smallest.

    Blank texts belong to no set; equal rows under different ids are copies; an
    empty input gives no row.
    """
    clean, split = _groups(marks)
    a = marks.select("row_id", "h1", "h2").join(clean.where("n > 1"), ["h1", "h2"])
    b = marks.join(split.where("n > 1"), ["h1", "h2", "check"])
    rows = [x.where("row_id <> keep").select(F.col("keep").alias("keep_rec_id"), F.col("row_id").alias("copy_rec_id")) for x in (a, b)]
    return rows[0].unionByName(rows[1])


def copy_counts(marks: DataFrame) -> DataFrame:
    """`keep_rec_id, n_copies` of every record that stays, 1 where it is alone."""
    clean, split = _groups(marks)
    return clean.select(F.col("keep").alias("keep_rec_id"), F.col("n").alias("n_copies")).unionByName(
        split.select(F.col("keep").alias("keep_rec_id"), F.col("n").alias("n_copies"))
    )
