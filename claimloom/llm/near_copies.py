"""Near-duplicate records with small edits (problem 6).

Records become sets of hashed word shingles; records with equal sets form a
class, and only one row per class goes on.  `similar_classes` finds the similar
classes exactly, by a pigeonhole over a partition of the universe of shingles:

* A sketch sized by the corpus counts the classes each shingle occurs in.  A
  shingle met once is in no other class: it stays in a set's size but can count
  only against a pair, so it is left out.  Counts can only be too high, which
  costs candidates and never a pair.
* Sets are banded by size, two bands a doubling.  Each band cuts the universe into
  segments of its own, so that a set of the band has two or three shingles in each.
* A set is indexed in its own band by the subsets of its segments: each shingle
  and each two shingles of a segment.
* Each set looks for partners of its size or less, in its own band and the bands
  below that may hold them.  Of its shingles at most A may be missing from a
  partner, so of any A + 1 disjoint subsets one lies wholly in the partner, in
  the same segment.  Subsets are two neighbours of a segment, worth one unit, or,
  as its one-deletion neighbourhood, both apart, worth two; left over ones are
  single.  Which A + 1 units are looked up is a matter of cost: those whose
  rarest shingle is rarest.  A few more are looked up than need be, and a partner
  must then hold so many more; one that is larger than the band's smallest, too.
* Sketches of the subsets indexed and looked up are broadcast, of bounded size.
  A unit by which no other set is indexed costs nothing and is never shuffled, so
  a set with enough of them is done with; an indexed subset nobody looks up stays
  behind, too.
* Every candidate is verified on its whole sets, with 64 bits of each shingle.

Shuffled rows are a subset's hash, a record and its size: a text is read once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import dropped, written, written_in_parts

RANGES = 16
#: Numbers of slots a sketch may have, as powers of two; within them it is sized by what it counts.
LEAST_SLOTS, MOST_SLOTS = 16, 28
FLUSH = 2_000_000
PARTS = 4
#: Rounds in which subsets are joined, each with its share of the hashes: shuffle files of one are gone before the next.
ROUNDS = 2
#: Units looked up beyond those that suffice to find a partner: more rows to join, fewer sets to verify.
SPARE = 3
#: Bands of sizes in each doubling of the size.
BANDS = 2
#: Segments of a band per size of its smallest set.
SEGMENTS = 0.5
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_WORDS: dict[str, int] = {}


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of `width` words.

    A text with fewer words counts as one run of all its words.
    """
    if len(_WORDS) > 300_000:
        _WORDS.clear()
    ws = words(text)
    hashes = list(map(_WORDS.get, ws))
    if None in hashes:
        for i, h in enumerate(hashes):
            if h is None:
                hashes[i] = _WORDS[ws[i]] = xxhash.xxh3_64_intdigest(ws[i])
    h = np.array(hashes, np.uint64)
    width = max(1, min(width, len(h)))
    g = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        g = (g ^ (g >> np.uint64(31))) * _A + h[k : k + len(g)] * _B
        g = (g ^ (g >> np.uint64(29))) * _C
    g.sort()
    return g[np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))] if len(g) else g


# --- sketches ------------------------------------------------------------------


def _pack(slots: np.ndarray) -> bytes:
    """Sorted slots as 16-bit gaps; a gap of 65535 or more is written as that many steps of 65535."""
    if not len(slots):
        return bytes(4)
    gaps = np.diff(slots.astype(np.int64), prepend=int(slots[0]))
    steps = gaps // 65535
    if steps.any():
        wide = np.full(int(steps.sum()) + len(gaps), 65535)
        wide[np.cumsum(steps + 1) - 1] = gaps % 65535
        gaps = wide
    return int(slots[0]).to_bytes(4, "little") + zlib.compress(gaps.astype(np.uint16).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    if len(data) <= 4:
        return np.empty(0, np.int64)
    gaps = np.frombuffer(zlib.decompress(data[4:]), np.uint16).astype(np.int64)
    at = int.from_bytes(data[:4], "little") + np.cumsum(gaps)
    return at[gaps != 65535]


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


class _Blocks:
    """Hashes on their way into sketches: kept until there are many, then given out as blocks of slots by range."""

    SCHEMA = "sketch int, range int, slots binary"

    def __init__(self, shapes: dict[int, tuple[int, int]]) -> None:
        self.bits, self.held, self.size = {k: bits for k, (bits, _) in shapes.items()}, {k: [] for k in shapes}, 0

    def add(self, sketch: int, hashes: np.ndarray) -> None:
        self.held[sketch].append(hashes)
        self.size += len(hashes)

    def full(self) -> bool:
        return self.size > FLUSH

    def flush(self) -> pa.RecordBatch:
        rows = []
        for sketch, held in self.held.items():
            slots = np.sort(_slot(np.concatenate(held), self.bits[sketch])) if held else np.empty(0, np.int64)
            cut = np.searchsorted(slots, np.arange(1, RANGES) * ((1 << self.bits[sketch]) // RANGES))
            rows += [(sketch, k, _pack(part)) for k, part in enumerate(np.split(slots, cut)) if len(part)]
            self.held[sketch] = []
        self.size = 0
        arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))]
        return pa.RecordBatch.from_arrays(arrays, names=["sketch", "range", "slots"])


def _bits_for(count: int) -> int:
    """Slots, as a power of two, for so many hashes: between one and two a hash while the bound allows."""
    return max(LEAST_SLOTS, min(MOST_SLOTS, int(count).bit_length()))


def _levels(blocks: DataFrame, shapes: dict[int, tuple[int, int]]) -> dict[int, bytes]:
    """The sketches, each of the shape (bits of a slot number, bits of a cell): a cell is the bit length of its slot's count, as far as it holds that."""

    def merge(key, table):  # noqa: ANN001, ANN202
        sketch, k = key[0].as_py(), key[1].as_py()
        bits, cell = shapes[sketch]
        width = (1 << bits) // RANGES
        count = np.zeros(width, np.uint32)
        for data in table.column("slots").to_pylist():
            at = _unpack(data) - k * width
            first = np.flatnonzero(np.diff(at, prepend=-1))
            count[at[first]] += np.diff(np.append(first, len(at))).astype(np.uint32)
        level = np.minimum(np.ceil(np.log2(count + 1.0)), (1 << cell) - 1).astype(np.uint8)
        packed = sum(level[i :: 8 // cell] << np.uint8(i * cell) for i in range(8 // cell))
        return pa.table({"sketch": pa.array([sketch], pa.int32()), "range": pa.array([k], pa.int32()), "level": pa.array([packed.tobytes()], pa.binary())})

    rows = blocks.groupBy("sketch", "range").applyInArrow(merge, "sketch int, range int, level binary").collect()
    got = {(r["sketch"], r["range"]): bytes(r["level"]) for r in rows}
    return {s: b"".join(got.get((s, k), bytes((1 << bits) // RANGES * cell // 8)) for k in range(RANGES)) for s, (bits, cell) in shapes.items()}


def _look(levels: np.ndarray, hashes: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    bits, cell = shape
    slot = _slot(hashes, bits)
    per = 8 // cell
    return levels[slot // per] >> (slot % per * cell).astype(np.uint8) & np.uint8((1 << cell) - 1)


# --- sets and their subsets ----------------------------------------------------


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    for i, title, text in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
        if text is not None and text.strip():
            yield i, f"{title or ''} {text}"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def shingle_sets(records: DataFrame, width: int) -> DataFrame:
    """`rec_id, h1, h2, shingles` of each record whose text isn't blank; h1 and h2 are the hash of its whole set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, h1, h2, sets = [], [], [], []
            for i, t in _texts(b):
                g = shingle_hashes(t, width)
                d = xxhash.xxh3_128_intdigest(g.tobytes())
                ids.append(i)
                h1.append(_signed(d >> 64))
                h2.append(_signed(d & (1 << 64) - 1))
                sets.append(g)
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            arrays = [*(pa.array(x, pa.int64()) for x in (ids, h1, h2)), _lists(flat.view(np.int64), np.array(list(map(len, sets)), np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["rec_id", "h1", "h2", "shingles"])

    return records.mapInArrow(scan, "rec_id bigint, h1 bigint, h2 bigint, shingles array<bigint>")


def least_overlap(size_sum: np.ndarray | int, threshold: float) -> np.ndarray:
    """The smallest overlap of two sets of these sizes together at the threshold."""
    return np.ceil(np.asarray(size_sum) * (threshold / (1 + threshold)) - 1e-9).astype(np.int64)


def smallest_partner(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.maximum(np.ceil(size * threshold - 1e-9).astype(np.int64), 1)


class _Sets:
    """The sets of one batch, laid end to end: `ids, size`, and of set `of` the sorted hashes `h` and how common each is."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, h: np.ndarray, kept: np.ndarray, level: np.ndarray | None = None) -> None:
        self.ids, self.size, self.h, self.kept, self.level = ids, size.astype(np.int64), h, kept.astype(np.int64), level
        self.of = np.repeat(np.arange(len(ids)), self.kept)

    @staticmethod
    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[_Sets]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                yield _Sets.read(b.slice(i, 2000))

    @staticmethod
    def read(b: pa.RecordBatch) -> _Sets:
        column = b.column("shingles")
        ends = column.offsets.to_numpy()
        level = b.column("levels").flatten().to_numpy(zero_copy_only=False).astype(np.int64) if "levels" in b.schema.names else None
        return _Sets(b.column("rec_id").to_numpy(), b.column("size").to_numpy(), column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(ends), level)


def band_of(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(size, 1)) * BANDS + 1e-9).astype(np.int64)


def smallest_of(band: int) -> int:
    return math.ceil(2 ** (band / BANDS) - 1e-6)


def _segment(h: np.ndarray, band: int) -> np.ndarray:
    """The segment of each hash: non-decreasing in the hash, so a sorted set lies segment by segment."""
    count = max(1, min(int(smallest_of(band) * SEGMENTS), (1 << 32) - 1))
    return ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)


def _one(h: np.ndarray, band: int) -> np.ndarray:
    x = (h + np.uint64(band)) * _A
    return (x ^ (x >> np.uint64(32))) * _C


def _two(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * _B + (b + np.uint64(band)) * _A
    return (x ^ (x >> np.uint64(32))) * _C


def index_subsets(sets: _Sets, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """`(hash, set number)` of all subsets by which the sets are indexed, each in its own band.

    Only sets that can have a partner of their size or more are indexed.
    """
    able = sets.kept >= least_overlap(2 * sets.size, threshold)
    bands = band_of(sets.size)
    hashes, of = [], []
    for band in np.unique(bands[able]):
        at = np.flatnonzero((able & (bands == band))[sets.of])
        h, own = sets.h[at], sets.of[at]
        place = own.astype(np.uint64) << np.uint64(32) | _segment(h, band)
        hashes.append(_one(h, band))
        of.append(own)
        i = np.arange(len(h) - 1)
        for d in range(1, len(h)):
            i = i[i + d < len(h)]
            i = i[place[i] == place[i + d]]
            if not len(i):
                break
            hashes.append(_two(h[i], h[i + d], band))
            of.append(own[i])
    none = np.empty(0, np.uint64)
    return np.concatenate(hashes or [none]), np.concatenate(of or [none.astype(np.int64)])


def lookup_subsets(sets: _Sets, threshold: float, found: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(hash, set number, slack)` of the subsets each set looks up.

    `found` gives a class of how many sets are indexed by a hash: 0 for none, 1
    for one.  Units nobody else is indexed by cost nothing, count like others and
    are left out of the result.  A partner holds at least as many units as the
    overlap it needs is greater than the slack.
    """
    bands = band_of(sets.size)
    least = smallest_partner(sets.size, threshold)
    indexed = sets.kept >= least_overlap(2 * sets.size, threshold)
    hashes, of, slack = [], [], []
    for band in range(int(band_of(least).min()) if len(least) else 0, int(bands.max()) + 1 if len(bands) else 0):
        low = np.maximum(least, smallest_of(band))
        missing = sets.kept - least_overlap(sets.size + low, threshold)
        mask = (band_of(least) <= band) & (bands >= band) & (low <= sets.size) & (missing >= 0)
        if not mask.any():
            continue
        at = np.flatnonzero(mask[sets.of])
        h, own, level = sets.h[at], sets.of[at], sets.level[at]
        # In its own band a set meets itself, if it is indexed.
        itself = ((bands == band) & indexed)[own]
        place = own.astype(np.uint64) << np.uint64(32) | _segment(h, band)
        begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        sizes = np.diff(np.append(begins, len(h)))
        nth = np.arange(len(h)) - np.repeat(begins, sizes)
        left = np.repeat(sizes, sizes) - nth
        first = np.flatnonzero((nth % 2 == 0) & (left > 1))  # with its neighbour, a subset of two
        alone = np.flatnonzero((nth % 2 == 0) & (left == 1))
        one, two = _one(h, band), _two(h[first], h[first + 1], band)
        ones, twos = found(one), found(two)
        ones, twos = np.where(ones > itself, ones * 64 + level * 2 + 1, 0), np.where(twos > itself[first], twos * 64 + np.minimum(level[first], level[first + 1]) * 2, 0)
        # What one more unit costs: a subset of two, then its two shingles apart instead; or a single one.
        apart = np.maximum(np.maximum(ones[first], ones[first + 1]), twos)
        # One number each, to sort by set, cost and kind: 20, 10, 2 and 32 bits with the place in its kind.
        key = lambda k, places, cost: own[places] << 44 | cost << 34 | k << 32 | np.arange(len(places))
        units = np.sort(np.concatenate([key(0, first, twos), key(1, first, apart), key(2, alone, ones[alone])]))
        who, what, nth = units >> 44, units >> 32 & 3, units & 0xFFFFFFFF
        begins = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        rank = np.arange(len(who)) - np.repeat(begins, np.diff(np.append(begins, len(who))))
        taken = rank <= missing[who] + SPARE
        own_slack = sets.kept - np.bincount(who[taken], minlength=len(sets.ids))
        what, nth = what[taken], nth[taken]
        whole = np.zeros(len(first), bool)
        whole[nth[what == 0]] = True
        whole[nth[what == 1]] = False
        whole &= twos > 0
        single = np.concatenate([first[nth[what == 1]], first[nth[what == 1]] + 1, alone[nth[what == 2]]])
        single = single[ones[single] > 0]
        both, who = np.concatenate([two[whole], one[single]]), np.concatenate([own[first[whole]], own[single]])
        # A set with fewer units than even its smallest partner would hold has none.
        enough = np.bincount(who, minlength=len(sets.ids)) >= least_overlap(sets.size + low, threshold) - own_slack
        hashes.append(both[enough[who]])
        of.append(who[enough[who]])
        slack.append(own_slack[of[-1]])
    none = np.empty(0, np.int64)
    hashes, of, slack = np.concatenate(hashes or [none.view(np.uint64)]), np.concatenate(of or [none]), np.concatenate(slack or [none])
    return hashes, of, slack


# --- the join ------------------------------------------------------------------


_FOUR, _TWO, _ONE = 4, 2, 1


def _count_shingles(firsts: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Blocks of a sketch of all shingles; `firsts` has one set of each class."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks({0: shape})
        for b in batches:
            blocks.add(0, b.column("shingles").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            if blocks.full():
                yield blocks.flush()
        yield blocks.flush()

    return firsts.select("shingles").mapInArrow(scan, _Blocks.SCHEMA)


def _met_again(firsts: DataFrame, threshold: float, sketch: object, shape: tuple[int, int]) -> DataFrame:
    """`rec_id, size, shingles, levels`: sets without the shingles met once, where enough are left for a partner."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = np.frombuffer(sketch.value, np.uint8)
        for b in batches:
            sets = _Sets.read(b)
            level = _look(counted, sets.h, shape)
            kept = np.bincount(sets.of[level > 1], minlength=len(sets.ids))
            some = (kept >= least_overlap(sets.size + smallest_partner(sets.size, threshold), threshold)) & (kept > 0)
            mask = (level > 1) & some[sets.of]
            arrays = [pa.array(sets.ids[some], pa.int64()), pa.array(sets.size[some], pa.int32()), _lists(sets.h[mask].view(np.int64), kept[some]), _lists(level[mask].view(np.int8), kept[some])]
            yield pa.RecordBatch.from_arrays(arrays, names=["rec_id", "size", "shingles", "levels"])

    return firsts.select("rec_id", "size", "shingles").mapInArrow(scan, "rec_id bigint, size int, shingles array<bigint>, levels array<tinyint>")


def _found(sketch: object, shape: tuple[int, int]) -> Callable[[np.ndarray], np.ndarray]:
    cells = np.frombuffer(sketch.value, np.uint8)
    return lambda hashes: _look(cells, hashes, shape).astype(np.int64)


def _count_indexed(sets: DataFrame, threshold: float, shape: tuple[int, int]) -> DataFrame:
    """Blocks of a sketch of the subsets the sets are indexed by."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks({0: shape})
        for own in _Sets.read_all(batches):
            blocks.add(0, index_subsets(own, threshold)[0])
            if blocks.full():
                yield blocks.flush()
        yield blocks.flush()

    return sets.mapInArrow(scan, _Blocks.SCHEMA)


def _looked_up(sets: DataFrame, threshold: float, there: object, shape: tuple[int, int], wanted: tuple[int, int]) -> DataFrame:
    """`subset, x, info_x`: what each set looks up, its size and slack in one number; and blocks of a sketch of these subsets."""
    names = ["subset", "x", "info_x", "sketch", "range", "slots"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _found(there, shape)
        blocks = _Blocks({0: wanted})

        def flushed() -> pa.RecordBatch:
            b = blocks.flush()
            return pa.RecordBatch.from_arrays([*[pa.nulls(b.num_rows, pa.int64())] * 3, *b.columns], names=names)

        for own in _Sets.read_all(batches):
            hashes, of, slack = lookup_subsets(own, threshold, found)
            blocks.add(0, np.unique(hashes))
            arrays = [pa.array(hashes.view(np.int64)), pa.array(own.ids[of], pa.int64()), pa.array(own.size[of] << 32 | slack)]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(len(of), k) for k in (pa.int32(), pa.int32(), pa.binary()))], names=names)
            if blocks.full():
                yield flushed()
        yield flushed()

    return sets.mapInArrow(scan, f"subset bigint, x bigint, info_x bigint, {_Blocks.SCHEMA}")


def _indexed(sets: DataFrame, threshold: float, asked: object, shape: tuple[int, int], k: int) -> DataFrame:
    """`subset, y, info_y` of round `k`: where each set can be found; its size and that of its largest possible partner in one number."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _found(asked, shape)
        share = threshold / (1 + threshold)
        for own in _Sets.read_all(batches):
            hashes, of = index_subsets(own, threshold)
            some = hashes.view(np.int64) % ROUNDS == k
            hashes, of = hashes[some], of[some]
            some = wanted(hashes) > 0
            hashes, of = hashes[some], of[some]
            reach = np.minimum(np.floor(own.kept / share + 1e-6) - own.size, np.floor(own.size / threshold + 1e-6)).clip(0, (1 << 31) - 1).astype(np.int64)
            arrays = [pa.array(hashes.view(np.int64)), pa.array(own.ids[of], pa.int64()), pa.array((own.size << 32 | reach)[of])]
            yield pa.RecordBatch.from_arrays(arrays, names=["subset", "y", "info_y"])

    return sets.mapInArrow(scan, "subset bigint, y bigint, info_y bigint")


def similar_classes(
    records: DataFrame, threshold: float, width: int, row_id: str = "rec_id", title: str = "title", text: str = "text", broadcast_rows: int = 1_000_000
) -> tuple[DataFrame, DataFrame]:
    """`(members, pairs)`: `rec_id, rep` of every record, and `a, b, overlap, size_sum` of similar classes.

    A class is named by its smallest record; a < b.  Records whose text is null
    or blank are in no class; of repeated ids each row counts.  Lists of ids (of
    copies, and of sets with a candidate) are broadcast up to `broadcast_rows`
    of them and joined by shuffling beyond; either way the result is the same.
    """
    spark = records.sparkSession
    few = lambda ids: F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    shared = spark.sparkContext.broadcast
    rows = records.select(F.col(f"`{row_id}`").cast("bigint"), F.col(f"`{title}`"), F.col(f"`{text}`"))
    every = written(shingle_sets(rows, width).withColumn("size", F.size("shingles")), "shingles")
    marks = every.select("rec_id", "h1", "h2")
    members = written(marks.join(marks.groupBy("h1", "h2").agg(F.min("rec_id").alias("rep")), ["h1", "h2"]).select("rec_id", "rep"), "members")
    copies = few(members.where("rec_id <> rep").select("rec_id"))
    shape = _bits_for(every.agg(F.sum("size")).first()[0] or 0), _FOUR
    sketch = shared(_levels(_count_shingles(every.join(copies, "rec_id", "left_anti"), shape), {0: shape})[0])
    # In parts, so that the whole sets and the shortened ones are never both there.
    sets = written_in_parts(every, lambda part: _met_again(part.join(copies, "rec_id", "left_anti"), threshold, sketch, shape), "sets", PARTS)
    sketch.destroy()
    wide = _bits_for(2 * (sets.agg(F.sum(F.size("levels"))).first()[0] or 0))
    many, any_ = (wide, _TWO), (wide, _ONE)
    there = shared(_levels(_count_indexed(sets, threshold, many), {0: many})[0])
    told = written(_looked_up(sets, threshold, there, many, any_), "lookups")
    there.destroy()
    asked = shared(_levels(told.where("slots is not null").select("sketch", "range", "slots"), {0: any_})[0])
    high, low = lambda c: F.shiftright(c, 32), lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    size_x, size_y = high("info_x"), high("info_y")
    smaller = (size_y < size_x) | ((size_y == size_x) & (F.col("y") < F.col("x")))
    least = F.ceil((size_x + size_y) * (threshold / (1 + threshold)) - 1e-9) - low("info_x")
    rounds = []
    for k in range(ROUNDS):
        look = told.where("subset is not null").where(F.pmod("subset", F.lit(ROUNDS)) == k).select("subset", "x", "info_x")
        met = look.join(_indexed(sets, threshold, asked, any_, k), "subset").where(smaller & (size_x <= low("info_y")))
        rounds.append(written(met.select("x", "y", least.cast("int").alias("least")).groupBy("x", "y", "least").agg(F.count("*").alias("n")), "met"))
    met = reduce(DataFrame.unionByName, rounds).groupBy("x", "y", "least").agg(F.sum("n").alias("n")).where("n >= least")
    met = written(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "candidates")
    asked.destroy()
    dropped(told, *rounds)
    # Only sets that some candidate needs are sent on.
    needed = sets.join(few(met.select(F.explode(F.array("a", "b")).alias("rec_id")).distinct()), "rec_id", "left_semi")
    side = lambda k: needed.select(F.col("rec_id").alias(k), F.col("size").alias(f"size_{k}"), F.col("shingles").alias(f"set_{k}"))
    checked = met.join(side("a"), "a").join(side("b"), "b")
    checked = checked.select("a", "b", (F.col("size_a") + F.col("size_b")).alias("size_sum"), F.size(F.array_intersect("set_a", "set_b")).alias("overlap"))
    pairs = written(checked.where(F.col("overlap") >= F.col("size_sum") * (threshold / (1 + threshold)) - 1e-9), "pairs")
    dropped(met, sets)
    return members, pairs


def near_copy_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """`rec_id_a, rec_id_b`, a < b: class pairs spread over their members, and pairs within classes."""
    one = members.select(F.col("rep").alias("a"), F.col("rec_id").alias("x"))
    two = members.select(F.col("rep").alias("b"), F.col("rec_id").alias("y"))
    across = pairs.select("a", "b").join(one, "a").join(two, "b")
    within = one.join(two, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y")))
    both = across.select("x", "y").unionByName(within.select("x", "y"))
    return both.select(F.least("x", "y").alias("rec_id_a"), F.greatest("x", "y").alias("rec_id_b"))
