from datetime import datetime

import pytest

from claimloom.llm import survivors

CAND = "run_id string, key string, title string, text string, snippet string, url string, publisher string, published_at string, provider string, kind string, content_status string, retrieved_at timestamp"


def made(spark, rows, groups, extra=()):
    cand = spark.createDataFrame([("r", k, t, x, "", u, p, d, "prov", kind, st, datetime(2026, 1, day) if day else None) for k, t, x, u, p, d, kind, st, day in rows], CAND)
    pubs = spark.createDataFrame([("Lentera Selat", "Asia/Jakarta", "DMY")], "publisher string, time_zone string, date_order string")
    dedup = spark.createDataFrame([("k3", "lentera-selat")] + list(extra), "key string, publisher string")
    return survivors.prepared(cand, spark.createDataFrame(groups, "key string, duplicate_cluster_id string"), pubs, dedup)


ROWS = [
    ("k1", "T1", "text", " ", None, "2025-01-01T00:00:00Z", "news", "Snippet Only", 1),
    ("k1", "T1b", "text", "", None, "2025-01-01T00:00:00Z", "news", "FULL", 2),
    ("k1", "T1b", "text", "", None, "2025-01-01T00:00:00Z", "news", "FULL", 2),
    ("k2", None, " ", "u2", "P", "never", "fact_check", "full", 1),
    ("k3", " ", "text", None, None, "02/01/2025 10:00", "web", " full", 1),
    ("k4", "T4", "text", "u4", "Q", None, "official", "excerpt-only", None),
    ("k9", "T9", "text", "u9", "Q", "2025-05-05T00:00:00Z", "official", "full", 1),
]
GROUPS = [("k1", "c"), ("k2", "c"), ("k2", "c"), ("k3", "c"), ("k4", "c"), ("k9", "alone"), ("k9", "alone"), (None, "c"), ("k4", None), ("gone", "far"), ("gone2", "far")]


def test_order(spark):
    got = {(r.duplicate_cluster_id, r.field_name): r.best_key for r in survivors.survivors(made(spark, ROWS, GROUPS)).collect()}
    # k3's date has no zone of its own, its outlet is known from the other table: it is the latest of the full ones.
    assert got == {("c", "record"): "k3", ("c", "title"): "k1", ("c", "url"): "k4", ("c", "publisher"): "k4", ("c", "published_at"): "k3"}


def test_empty(spark):
    assert survivors.survivors(made(spark, ROWS, GROUPS).limit(0)).count() == 0
    assert survivors.truth_discovery(made(spark, ROWS, GROUPS).limit(0)).count() == 0


def test_truth_discovery_prefers_the_reliable(spark):
    rows, groups = [], []
    for c in range(20):
        for source, title in (("good1", f"right {c}"), ("good2", f"right {c}"), ("bad", f"wrong {c}")):
            rows.append((f"c{c}", f"{c}{source}", title, None, None, None, source))
    # one cluster in which a reliable source stands against an unreliable one
    rows += [("x", "x1", "alpha", None, None, None, "bad"), ("x", "x2", "beta", None, None, None, "good1")]
    df = spark.createDataFrame(rows, "duplicate_cluster_id string, key string, title string, url string, publisher string, utc_us long, provider string")
    got = {r.duplicate_cluster_id: r for r in survivors.truth_discovery(df).where("field_name = 'title'").collect()}
    assert got["x"].best_key == "x2" and got["x"].support > 0.5
    assert all(got[f"c{c}"].value == f"right{c}" for c in range(20))


def test_full_width_date_finds_its_outlet(spark):
    rows = [("k3", "T", "text", None, None, "０２／０１／２０２５ １０：００", "web", "full", 1), ("k2", "T", "text", None, "P", "2025-01-01T00:00:00Z", "web", "full", 1)]
    got = {r.key: r.utc_us for r in made(spark, rows, [("k3", "c"), ("k2", "c")]).collect()}
    assert got == {"k3": 1735786800 * 1_000_000, "k2": 1735689600 * 1_000_000}


def test_truth_discovery_settles_or_fails(spark):
    rows = [(f"c{c}", f"{c}{p}", t, None, None, None, p) for c in range(9) for p, t in (("a", "x"), ("b", "x" if c % 3 else "y"), ("d", "y"))]
    df = spark.createDataFrame(rows, "duplicate_cluster_id string, key string, title string, url string, publisher string, utc_us long, provider string")
    with pytest.raises(RuntimeError, match="still move"):
        survivors.truth_discovery(df, rounds=1)
    got, finer = ({r.duplicate_cluster_id: (r.value, r.support) for r in survivors.truth_discovery(df, tolerance=t, broadcast_sources=n).collect()} for t, n in ((1e-4, 100_000), (1e-6, 0)))
    assert all(got[c][0] == finer[c][0] and abs(got[c][1] - finer[c][1]) < 0.01 for c in finer)


def test_truth_discovery_weighs_content(spark):
    rows = [("k1", "Snippet", " ", None, None, None, "web", "full", 1), ("k2", "Snippet", "text", None, None, None, "web", "snippet only", 1), ("k3", "Whole", "text", None, None, None, "web", "full", 1)]
    got = survivors.truth_discovery(made(spark, rows, [(k, "c") for k in ("k1", "k2", "k3")])).where("field_name = 'title'").first()
    assert got.best_key == "k3" and abs(got.support - 1 / 1.75) < 1e-6
