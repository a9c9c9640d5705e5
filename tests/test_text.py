import hashlib
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.functions import jcs, python_text, tokens, urls
from claimloom.functions.text import alnum_only, is_blank, words


def test_keys():
    assert alnum_only(" Ｌｅｎｔｅｒａ-Selat. ") == "lenteraselat"
    assert alnum_only("STRASSE") == alnum_only("Straße") == "strasse"
    assert words("a_b c-d's") == ["a", "b", "c", "d", "s"]
    assert alnum_only(None) is None


def test_blank(spark):
    df = spark.createDataFrame([(None,), ("",), (" \u00a0\t",), ("x",)], "s string")
    assert [r[0] for r in df.select(is_blank(F.col("s"))).collect()] == [True, True, True, False]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://www.Example.com:80/a/b/?utm_source=x&b=2&a=1#top", "http://example.com/a/b?a=1&b=2"),
        ("https://user:pw@h.org:8443", "https://h.org:8443/"), ("https://h.org/?REF=1&q=", "https://h.org/?q="),
        ("ftp://h.org/x", None), ("/x", None), ("", None), (None, None), ("http://h.org:99999/", None), ("https://h.org/a?b=1%202&a=x+y", "https://h.org/a?a=x+y&b=1+2"),
    ],
)
def test_canonical(url, want):
    assert urls.canonical(url) == want
    assert want is None or urls.canonical(want) == want


def test_domain():
    assert [urls.domain(u) for u in ("http://a.b.co.id/x", "https://www.h.org.", "ftp://x.y.z", "nothing", None)] == ["b.co.id", "h.org", "y.z", None, None]


def test_tokens(spark):
    df = spark.createDataFrame([("Die Straße dan HOAKS_1 tidak",), (None,), ("",)], "t string")
    rows = df.select(tokens.search_tokens(F.col("t")), tokens.content_tokens(F.col("t")), tokens.shingles(tokens.content_tokens(F.col("t")), 2), tokens.shingles(tokens.content_tokens(F.col("t")), 9)).collect()
    assert list(rows[0]) == [["die", "straße", "dan", "hoaks_1", "tidak"], ["die", "strasse", "hoaks_1", "tidak"], ["die strasse", "strasse hoaks_1", "hoaks_1 tidak"], ["die strasse hoaks_1 tidak"]]
    assert list(rows[1]) == list(rows[2]) == [[], [], [], []]


def test_simhash(spark):
    toks = "one two three four five six seven".split()
    df = spark.createDataFrame([(1, toks), (2, [])], "k int, t array<string>").withColumn("g", tokens.shingles(F.col("t"), 4))
    got = {r.k: (r.hi, r.lo) for r in tokens.simhash(df, "k", "g").collect()}
    votes = [0] * 64
    for i in range(4):
        h = int(hashlib.sha256(" ".join(toks[i : i + 4]).encode()).hexdigest()[:16], 16)
        votes = [v + (1 if h >> b & 1 else -1) for b, v in enumerate(votes)]
    want = sum(1 << b for b, v in enumerate(votes) if v > 0)
    assert got == {1: (want >> 32, want & 0xFFFFFFFF), 2: (0, 0)}


@given(st.text(max_size=900), st.lists(st.text(min_size=1, max_size=4), max_size=4))
def test_excerpt(text, wanted):
    e = python_text.excerpt(text, {w.casefold() for w in wanted})
    assert e in text and len(e) <= 320


def test_excerpt_picks_densest():
    text = "Nothing here. " * 40 + "The flood hit the flood wall. " + "More words follow. " * 30
    assert python_text.excerpt(text, {"flood"}).count("flood") == 2
    assert python_text.excerpt(text, set()) == text[:320]


@pytest.mark.parametrize(
    ("x", "want"),
    [(0.0, "0"), (-0.0, "0"), (1.0, "1"), (1e21, "1e+21"), (1e-7, "1e-7"), (0.000001, "0.000001"), (123456789.125, "123456789.125"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (-1.5, "-1.5"), (100.0, "100"), (333333333.33333329, "333333333.3333333")],
)
def test_numbers(x, want):
    assert jcs.number(x) == want


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**53) + 1, 2**53 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"])), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"])), c, max_size=4), max_leaves=12))
def test_canonical_json_round_trip(v):
    # Large numbers are written in full digits, so integers are read back as floats.
    assert json.loads(jcs.canonical_json(v), parse_int=float) == v


def test_strict_json(spark):
    assert jcs.canonical_json({"\u20ac": 1, "\r": 2, "\U0001f600": 3, "1": 4, "\ufb33": 5}) == '{"\\r":2,"1":4,"€":1,"😀":3,"\ufb33":5}'
    for bad in ('{"a":1,"a":2}', "NaN", "[Infinity]", b"\xef\xbb\xbf{}"):
        with pytest.raises(ValueError):
            jcs.parse_strict(bad)
    for bad in (2**53, float("inf"), "\ud800", {1}):
        with pytest.raises(jcs.NotCanonical):
            jcs.canonical_json(bad)
    df = spark.createDataFrame([('{"b":1.0,"a":[]}',), ("x",), (None,)], "j string")
    assert [r[0] for r in df.select(jcs.canonical_column(F.col("j"))).collect()] == ['{"a":[],"b":1}', None, None]
