import random

from pyspark.sql import functions as F

from claimloom.llm import exact_copies, near_copies

COPY = "rec_id long, text string, url string"


def test_exact_copies(spark):
    rows = [
        (1, "Hello, World!", "http://h.org/a?b=1&a=2"), (2, "hello   world", "http://www.h.org/a/?a=2&b=1#x"), (3, "HELLO-WORLD", None), (4, "Ｈｅｌｌｏ world", " "), (5, "helloworld", "ftp://h.org"), (6, "Helloworld", "ftp://h.org"),
        (7, None, None), (8, " ", None), (9, "other", None), (2, "hello   world", "http://h.org/a?a=2&b=1"),
    ]
    df = spark.createDataFrame(rows, COPY).withColumn("keep", F.lit("clash"))
    marks = exact_copies.fingerprints(df)
    assert {(r.keep_rec_id, r.copy_rec_id) for r in exact_copies.copy_rows(marks).collect()} == {(1, 2), (3, 4), (5, 6)}
    assert {r.keep_rec_id: r.n_copies for r in exact_copies.copy_counts(marks).collect()} == {1: 3, 3: 2, 5: 2, 9: 1}
    assert exact_copies.copy_rows(exact_copies.fingerprints(df.limit(0))).count() == 0


def test_collided_hashes_are_split(spark):
    marks = spark.createDataFrame([(1, 5, 5, 7), (2, 5, 5, 8), (3, 5, 5, 7), (4, 6, 6, 1)], "row_id long, h1 long, h2 long, check long")
    assert {(r[0], r[1]) for r in exact_copies.copy_rows(marks).collect()} == {(1, 3)}
    assert {(r[0], r[1]) for r in exact_copies.copy_counts(marks).collect()} == {(1, 2), (2, 1), (4, 1)}


def brute(rows, width, threshold):
    sets = {}
    for i, title, text in rows:
        if text and text.strip():
            sets[i] = frozenset(near_copies.shingle_hashes(f"{title or ''} {text}", width).tolist())
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def stories(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        base = [f"w{r.randint(0, 60)}" for _ in range(r.randint(1, 60))]
        for j in range(r.randint(1, 4)):
            text = [w if r.random() > 0.04 * j else f"x{r.randint(0, 9)}" for w in base][: len(base) - r.randint(0, 3 * j)]
            rows.append((len(rows), r.choice([None, "Title of it"]), " ".join(text)))
    return rows + [(9000, None, None), (9001, "t", " "), (9002, None, "one"), (9003, "", "One!"), (9004, None, "...")] + [(9100 + i, None, "the very same text told again and again") for i in range(30)]


def test_near_copies_are_brute_force(spark):
    for seed, width, threshold in ((1, 3, 0.5), (2, 5, 0.8), (3, 2, 0.6)):
        rows = stories(seed, 30)
        df = spark.createDataFrame(rows, "rec_id long, title string, text string")
        # Ids of copies broadcast or, beyond the bound, joined by shuffling: the same result.
        members, pairs = near_copies.similar_classes(df, threshold, width, broadcast_rows=0 if seed == 2 else 1_000_000)
        got = [(r.rec_id_a, r.rec_id_b) for r in near_copies.near_copy_pairs(members, pairs).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, width, threshold)


def test_near_copies_of_nothing(spark):
    df = spark.createDataFrame([], "rec_id long, title string, text string")
    assert near_copies.near_copy_pairs(*near_copies.similar_classes(df, 0.5, 3)).count() == 0


def test_lookups_meet_every_similar_set():
    """Of random sets over the threshold, each pair shares a subset looked up by the larger and indexed by the smaller."""
    import numpy as np

    r = np.random.default_rng(5)
    for threshold in (0.3, 0.5, 0.8):
        sets = []
        for _ in range(60):
            base = r.integers(0, 1 << 63, int(r.integers(1, 90)), dtype=np.uint64)
            for _ in range(3):
                sets.append(np.unique(np.concatenate([base[r.random(len(base)) < r.uniform(0.5, 1)], r.integers(0, 1 << 63, int(r.integers(1, 9)), dtype=np.uint64)])))
        size = np.array(list(map(len, sets)))
        own = near_copies._Sets(np.arange(len(sets)), size, np.concatenate(sets), size, r.integers(0, 16, int(size.sum())))
        by_hash, found = {}, {}
        for h, y in zip(*(v.tolist() for v in near_copies.index_subsets(own, threshold)), strict=True):
            by_hash.setdefault(h, set()).add(y)
        some = lambda hashes: np.array([min(len(by_hash.get(h, ())), 3) for h in hashes.tolist()], np.int64)
        for h, x, slack in zip(*(v.tolist() for v in near_copies.lookup_subsets(own, threshold, some)), strict=True):
            for y in by_hash.get(h, ()):
                found.setdefault((x, y, slack), []).append(h)
        for x, a in enumerate(sets):
            for y, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                if x != y and len(b) <= len(a) and both >= threshold * (len(a) + len(b) - both):
                    need = near_copies.least_overlap(len(a) + len(b), threshold)
                    assert any((p, q) == (x, y) and len(hs) >= max(1, need - slack) for (p, q, slack), hs in found.items())


def test_slot_blocks():
    import numpy as np

    for slots in ([], [5], [0, 0, 7, 70000, 70000 + 65535, 5_000_000]):
        a = np.array(slots, np.uint32)
        assert near_copies._unpack(near_copies._pack(a)).tolist() == slots


def test_large_sets(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    df = spark.createDataFrame([(1, None, long), (2, None, long + " more"), (3, None, "short one here")], "rec_id long, title string, text string")
    members, pairs = near_copies.similar_classes(df, 0.5, 3)
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]
