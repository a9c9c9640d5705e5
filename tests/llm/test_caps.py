import math
import random

import pytest

from claimloom.llm import contributor_caps as caps


@pytest.mark.parametrize(("count", "share"), [(2, None), (None, 0.3), (3, 0.5), (0, None)])
def test_caps_are_brute_force(spark, count, share):
    r = random.Random(11)
    rows = [(r.choice("aaab"), r.choice("xyyy"), f"k{i:03d}", r.choice([0.5, 0.5, r.random(), -r.random() * 50, None, float("nan"), float("inf")])) for i in range(300)]
    df = spark.createDataFrame(rows, "run string, who string, key string, score double")
    want = set()
    for g in {(a, b) for a, b, *_ in rows}:
        own = sorted((math.inf if s is None or s != s else -s, k) for a, b, k, s in rows if (a, b) == g)
        cap = min(x for x in (count, None if share is None else int(len(own) * share)) if x is not None)
        want |= {k for _, k in own[cap:]}
    got = [x.key for x in caps.beyond_cap(df, ["run", "who"], "score", "key", count, share).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_bins_never_decrease(spark):
    for xs in ([-1e9, -3.0, -0.1, 0.0, 0.001, 0.3, 0.9, 1.0, 5.0, 1e12], [0.0, 0.2, 0.21, 1.0], [-1.7e308, 0.0, 1.7e308], [0.5]):
        df = spark.createDataFrame([(x,) for x in sorted([*xs, float("inf"), float("-inf")], reverse=True)], "s double")
        bins = [r[0] for r in df.select(caps.quality_bin(df["s"], min(xs), max(xs))).collect()]
        assert bins == sorted(bins) and max(bins) < caps.BINS and bins[0] == 0


def test_one_tied_score_over_many_ranges(spark):
    df = spark.range(5000).selectExpr("'a' as who", "cast(id as string) as key", "0.5 as score").selectExpr("who", "key", "cast(score as double) as score")
    order = sorted(str(i) for i in range(5000))
    got = {r.key for r in caps.beyond_cap(df, ["who"], "score", "key", 1777).collect()}
    assert got == set(order[1777:])


def test_contributors(spark):
    from datetime import datetime as dt

    rows = [
        ("r", "k1", "g", 0.9, dt(2026, 1, 1)), ("r", "k1", "h", 0.1, dt(2026, 1, 2)), ("r", "k2", " ", 0.5, dt(2026, 1, 1)), ("r", "k3", None, 0.4, dt(2026, 1, 1)), ("r", "k4", "", 0.3, dt(2026, 1, 1)),
        ("r", "k5", None, None, dt(2026, 1, 1)), ("r", "k6", None, None, dt(2026, 1, 1)), (None, "k7", "g", 0.5, None), ("r", "k2", " ", 0.5, dt(2026, 1, 1)),
    ]
    items = caps.latest_items(spark.createDataFrame(rows, "run_id string, key string, independence_group_id string, relevance_score double, ranked_at timestamp"))
    names = spark.createDataFrame([("k2", "Lentera Selat"), ("k3", "LENTERA-selat"), ("k4", "lentera selat"), ("k5", " ")], "key string, publisher string")
    got = {r.key: r.contributor for r in caps.with_contributor(items, names).collect()}
    assert got == {"k1": "g:h", "k2": "p:lenteraselat", "k3": "p:lenteraselat", "k4": "p:lenteraselat", "k5": "i:k5", "k6": "i:k6"}
    over = caps.beyond_cap(caps.with_contributor(items, names), ["run_id", "contributor"], "relevance_score", "key", 2)
    assert [r.key for r in over.collect()] == ["k4"]
    assert caps.beyond_cap(items.limit(0), ["run_id"], "relevance_score", "key", 2).count() == 0
