from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.functions.timestamps import normalize_timestamps, readable
from claimloom.operators.instants import record_instants

UTC = timezone.utc


def us(*a, zone=UTC):
    d = datetime(*a, tzinfo=zone)
    return (d - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


CASES = [
    ("2025-05-29T13:49:11Z", None, us(2025, 5, 29, 13, 49, 11)),
    ("2024-05-29t18:24:32z", None, us(2024, 5, 29, 18, 24, 32)),
    ("  2025-09-16T01:25:21+09:00\n", None, us(2025, 9, 15, 16, 25, 21)),
    ("2025-07-11T11:49:44−05:00", None, us(2025, 7, 11, 16, 49, 44)),
    ("2024-12-23T19:24:00.115502659Z", None, us(2024, 12, 23, 19, 24, 0, 115502)),
    ("2026/05/06 14:08:08 UTC+07:00", None, us(2026, 5, 6, 7, 8, 8)),
    ("20250605T174520Z", None, us(2025, 6, 5, 17, 45, 20)),
    ("20240921", "DMY", us(2024, 9, 20, 17)),
    ("1710120684", None, 1710120684_000000),
    ("1708815083091", None, 1708815083091_000),
    ("18/04/2025 22:06", "DMY", us(2025, 4, 18, 15, 6)),
    ("11-03-2024 01:30:19", "MDY", us(2024, 11, 2, 18, 30, 19)),
    ("Sun, 05 Apr 2026 04:40:41 +0800", None, us(2026, 4, 4, 20, 40, 41)),
    ("Rabu, 15 Oktober 2025 08.39 WIT", None, us(2025, 10, 14, 23, 39)),
    ("17. Dezember 2024, 13:37 Uhr", "DMY", us(2024, 12, 17, 6, 37)),
    ("10 janvier 2026 à 16h04", "DMY", us(2026, 1, 10, 9, 4)),
    ("19 de maio de 2026 às 08h23", "DMY", us(2026, 5, 19, 1, 23)),
    ("Feb 29, 2024 12:00 AM", "DMY", us(2024, 2, 28, 17)),
    ("29 August 2025 at 4:39 pm", "DMY", us(2025, 8, 29, 9, 39)),
    ("2025-05-06", "DMY", us(2025, 5, 5, 17)),
    ("2025-02-30", "DMY", None), ("2026-13-45T08:00:00Z", None, None), ("2025-06-17T25:10:00Z", None, None), ("00/00/0000", "DMY", None),
    ("kemarin", "DMY", None), ("", "DMY", None), (None, "DMY", None), ("18/04/2025 22:06", None, None), ("2025-05-06 10:00:00", None, None),
]


def test_forms(spark):
    rows = [(i, t, o, "Asia/Jakarta" if o else None) for i, (t, o, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, t string, o string, z string")
    got = {r.i: r.v for r in normalize_timestamps(df, "t", "v", F.col("z"), F.col("o")).collect()}
    for i, (t, _, want) in enumerate(CASES):
        assert got[i] == want, t
    assert readable(normalize_timestamps(df, "t", "v", F.col("z"), F.col("o")), "v").count() == sum(w is not None for *_, w in CASES)


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024-11-03 01:30:00", us(2024, 11, 3, 5, 30)), ("2024-03-10 02:30:00", us(2024, 3, 10, 7, 30)), ("2024-07-01 12:00:00", us(2024, 7, 1, 16))],
)
def test_clock_changes(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert normalize_timestamps(df, "t", "v", F.lit("America/New_York")).first().v == want


@settings(max_examples=20, deadline=None)
@given(st.lists(st.datetimes(datetime(1900, 1, 1), datetime(2200, 1, 1)), min_size=1, max_size=40))
def test_day_arithmetic(spark, moments):
    df = spark.createDataFrame([(i, m.strftime("%Y-%m-%dT%H:%M:%S.%fZ").rjust(27, "0")) for i, m in enumerate(moments)], "i int, t string")
    got = {r.i: r.v for r in normalize_timestamps(df, "t", "v").collect()}
    assert got == {i: (m - datetime(1970, 1, 1)) // timedelta(microseconds=1) for i, m in enumerate(moments)}


def test_records(spark):
    pubs = spark.createDataFrame([("Lentera Selat", "Asia/Jakarta", "DMY"), ("Minnow County Post", "America/Chicago", "MDY")], "publisher string, time_zone string, date_order string")
    dedup = spark.createDataFrame([("k2", "ＭＩＮＮＯＷ-county post"), ("k3", None)], "key string, publisher string")
    rows = [(1, "k1", " lentera  selat.", "02/03/2024 10:00"), (2, "k2", " ", "02/03/2024 10:00"), (3, "k3", None, "02/03/2024 10:00"), (4, "k2", "Nobody", "02/03/2024 10:00"), (5, None, None, "2024-01-01T00:00:00Z"), (6, "k1", "x", None)]
    df = spark.createDataFrame(rows, "rec_id long, id string, publisher string, published_at string").withColumn("utc_us", F.lit("clash"))
    got = {r.rec_id: r.utc_us for r in record_instants(df, pubs, dedup).collect()}
    assert got == {1: us(2024, 3, 2, 10, zone=ZoneInfo("Asia/Jakarta")), 2: us(2024, 2, 3, 10, zone=ZoneInfo("America/Chicago")), 5: us(2024, 1, 1)}
    assert record_instants(df.limit(0), pubs, dedup).count() == 0


def test_full_width_digits_alone(spark):
    dates = ["２０２５-０１-０２T０３:００:００Z", "２０２５年", "０２／０１／２０２５ １０：００"]
    df = spark.createDataFrame([(1, "a", None, dates[0]), (2, "a", None, dates[1]), (3, "k", None, dates[2])], "rec_id long, id string, publisher string, published_at string")
    pubs = spark.createDataFrame([("Pos", "Asia/Jakarta", "DMY")], "publisher string, time_zone string, date_order string")
    dedup = spark.createDataFrame([("k", "pos")], "key string, publisher string")
    want = 1735786800 * 1_000_000  # 2025-01-02 03:00 UTC
    assert {r.rec_id: r.utc_us for r in record_instants(df, pubs, dedup).collect()} == {1: want, 3: want}


def test_negative_unix_times_of_any_length(spark):
    rows = [("-1234567",), ("-12345678",), ("-123456789",), ("20250101",)]
    got = [r.us for r in normalize_timestamps(spark.createDataFrame(rows, "t string"), "t", "us", F.lit("UTC")).collect()]
    assert got == [-1234567 * 1_000_000, -12345678 * 1_000_000, -123456789 * 1_000_000, 1735689600 * 1_000_000]
