"""Mixed timestamp texts to one UTC instant, inside the JVM.

All formats are alternatives of one regular expression with named groups.  A
single `regexp_replace` pass rewrites a text into its components (an unmatched
group contributes nothing, so groups of the same meaning are simply written
side by side), calendar ranges are checked, and the instant is put together by
integer day arithmetic.  Zone rules are only needed for texts without a zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names and abbreviations in the languages of the outlets (fixed values).
MONTHS = {
    1: "january jan januari januar jänner jän enero ene janvier janv janeiro",
    2: "february feb februari februar pebruari febrero février févr fév fevereiro fev",
    3: "march mar maret märz mär mrz marzo mars março",
    4: "april apr abril abr avril avr",
    5: "may mei mai mayo maio",
    6: "june jun juni junio juin junho",
    7: "july jul juli julio juillet juil julho",
    8: "august aug agustus agu agt agosto ago août",
    9: "september sep sept septiembre setiembre septembre setembro set",
    10: "october oct oktober okt octubre octobre outubro out",
    11: "november nov nopember noviembre novembre novembro",
    12: "december dec desember des dezember dez diciembre dic décembre déc dezembro",
}

# Named zones that may stand in a text, in minutes east of UTC (fixed values).
ZONES = {"Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WIB": 420, "WITA": 480, "WIT": 540}

#: A digit that can be read; a text without one names no instant.
DIGIT = "[0-9０-９]"

_ZONE = r"(?:UTC|GMT)?[+-][0-9]{1,2}(?::?[0-9]{2})?|Z|UTC|GMT|UT|WIB|WITA|WIT"
_AMPM = r"[ap]\.?m\.?"


def _clock(n: int, sep: str = ":.h") -> str:
    return (
        rf"(?<h{n}>[0-9]{{1,2}})[{sep}](?<i{n}>[0-9]{{2}})(?:[:.](?<s{n}>[0-9]{{2}})(?:[.,](?<f{n}>[0-9]+))?)?"
        rf"(?:\s*(?<p{n}>{_AMPM}))?(?:\s*(?:Uhr|h))?(?:\s*(?<z{n}>{_ZONE}))?"
    )


_AT = r"(?:,?\s+(?:à|às|at|um|a\s+las|pukul)?\s*|,\s*)"
_DAYNAME = r"(?:\p{L}+\.?,?\s+)?"
FORMATS = [
    # year first, separated
    rf"(?<y1>[0-9]{{4}})([-/.])(?<m1>[0-9]{{1,2}})\2(?<d1>[0-9]{{1,2}})(?:(?:T|,?\s+){_clock(1, ':')})?",
    # year first, compact
    rf"(?<y2>[0-9]{{4}})(?<m2>[0-9]{{2}})(?<d2>[0-9]{{2}})(?:T(?<h2>[0-9]{{2}}):?(?<i2>[0-9]{{2}})(?::?(?<s2>[0-9]{{2}})(?:[.,](?<f2>[0-9]+))?)?\s*(?<z2>{_ZONE})?)?",
    # all numbers, year last: the outlet's habit decides which is the day
    rf"(?<a3>[0-9]{{1,2}})[-/.](?<b3>[0-9]{{1,2}})[-/.](?<y3>[0-9]{{4}})(?:{_AT}{_clock(3)})?",
    # day and month name
    rf"{_DAYNAME}(?<d4>[0-9]{{1,2}})\.?\s+(?:de\s+)?(?<n4>\p{{L}}+)\.?,?\s+(?:de\s+)?(?<y4>[0-9]{{4}})(?:{_AT}{_clock(4)})?",
    # month name first
    rf"{_DAYNAME}(?<n5>\p{{L}}+)\.?\s+(?<d5>[0-9]{{1,2}}),?\s+(?<y5>[0-9]{{4}})(?:{_AT}{_clock(5)})?",
    # a count of seconds, milliseconds, microseconds or nanoseconds since 1970; eight digits without a sign are a date
    r"(?<e6>-[0-9]{1,19}|[0-9]{1,7}|[0-9]{9,19})",
]
PATTERN = "(?iuU)^(?:" + "|".join(FORMATS) + ")$"
_FIELDS = {
    "y": "y1 y2 y3 y4 y5", "m": "m1 m2", "d": "d1 d2 d4 d5", "a": "a3", "b": "b3", "n": "n4 n5",
    "h": "h1 h2 h3 h4 h5", "i": "i1 i2 i3 i4 i5", "s": "s1 s2 s3 s4 s5", "f": "f1 f2 f3 f4 f5",
    "p": "p1 p3 p4 p5", "z": "z1 z2 z3 z4 z5", "e": "e6",
}
_REPLACEMENT = "\x01|" + "|".join("".join(f"${{{g}}}" for g in gs.split()) for gs in _FIELDS.values())


def _components(text: Column) -> Column:
    clean = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    clean = F.translate(clean, "０１２３４５６７８９−：／－", "0123456789-:/-")
    return F.split(F.regexp_replace(clean, F.lit(PATTERN), F.lit(_REPLACEMENT)), r"\|", -1)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers only."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((F.when(m > 2, m - 3).otherwise(m + 9) * 153 + 2) / 5) + d - 1
    return (era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468).cast("long")


def normalize_timestamps(
    df: DataFrame, text: str, out: str, zone: Column | None = None, date_order: Column | None = None
) -> DataFrame:
    """Adds `out`: the microseconds since 1970-01-01 UTC that column `text` names, or null.

    A zone or offset in the text wins.  Without one `zone` (an IANA name, may be
    null) applies: of a wall time that occurs twice the earlier, and a skipped
    one moves on by the length of the gap.  `date_order` (DMY or MDY) decides
    all-number dates that don't begin with the year; without it those are null.
    A date alone means its first moment.  Digits beyond the microsecond are cut
    off.  Null, empty, impossible or other text gives null.  Other columns pass
    through untouched; helper columns carry reserved names and are dropped.
    Filter the result with `readable`, which keeps the parsing from being
    repeated inside a pushed-down predicate.
    """
    zone = F.lit(None).cast("string") if zone is None else zone
    order = F.upper(F.lit(None).cast("string") if date_order is None else date_order)
    keep = df.columns
    at = {k: i + 1 for i, k in enumerate(_FIELDS)}
    part = lambda k: F.nullif(F.col("__ts_parts")[at[k]], F.lit(""))
    num = lambda k: part(k).try_cast("int")
    month_of = F.create_map(*[F.lit(x) for m, names in MONTHS.items() for n in names.split() for x in (n, m)])
    df = df.withColumn("__ts_zone", zone).withColumn("__ts_order", order).withColumn("__ts_parts", _components(F.col(text)))
    df = df.withColumn("__ts_parts", F.when(F.col("__ts_parts")[0] == "\x01", F.col("__ts_parts")))

    a, b = num("a"), num("b")
    mdy = F.col("__ts_order") == "MDY"
    numeric = a.isNotNull()
    known = ~numeric | F.col("__ts_order").isin("DMY", "MDY")
    half, h12 = F.lower(F.substring(part("p"), 1, 1)), num("h")
    month = F.when(numeric, F.when(mdy, a).otherwise(b)).when(part("n").isNotNull(), F.element_at(month_of, F.lower(part("n")))).otherwise(num("m"))
    hour = F.when(half.isNull(), F.coalesce(h12, F.lit(0))).when(h12.between(1, 12), h12 % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(99)
    # Plain columns step by step, not one nested expression: each is computed once.
    df = df.select(
        *[F.col(f"`{c}`") for c in keep if c != out], "__ts_zone",
        F.when(known, num("y")).alias("__ts_y"), month.cast("int").alias("__ts_m"), F.when(numeric, F.when(mdy, b).otherwise(a)).otherwise(num("d")).alias("__ts_d"),
        hour.cast("int").alias("__ts_h"), F.coalesce(num("i"), F.lit(0)).alias("__ts_i"), F.coalesce(num("s"), F.lit(0)).alias("__ts_s"),
        F.coalesce(F.rpad(F.substring(part("f"), 1, 6), 6, "0").try_cast("long"), F.lit(0)).alias("__ts_us"),
        F.regexp_replace(F.upper(part("z")), r"^(UTC|GMT)(?=[+-])", "").alias("__ts_z"), part("e").alias("__ts_e"),
    )
    t = lambda k: F.col(f"__ts_{k}")
    df = df.withColumn("__ts_digits", F.regexp_replace(t("z"), r"[^0-9]", "")).withColumn("__ts_leap", ((t("y") % 4 == 0) & (t("y") % 100 != 0)) | (t("y") % 400 == 0))
    short = F.length(t("digits")) <= 2
    df = df.withColumn("__ts_oh", F.when(short, t("digits").try_cast("int")).otherwise(F.floor(t("digits").try_cast("int") / 100)).cast("int"))
    df = df.withColumn("__ts_om", F.when(short, 0).otherwise(t("digits").try_cast("int") % 100))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), t("z"))
    minutes = (t("oh") * 60 + t("om")) * F.when(t("z").startswith("-"), -1).otherwise(1)
    df = df.withColumn("__ts_off", F.coalesce(named, F.when((t("oh") <= 18) & (t("om") <= 59), minutes)))
    last = F.when(t("m") == 2, F.when(t("leap"), 29).otherwise(28)).when(t("m").isin(4, 6, 9, 11), 30).otherwise(31)
    ok = t("y").isNotNull() & t("m").between(1, 12) & t("d").between(1, last) & (t("h") <= 23) & (t("i") <= 59) & (t("s") <= 59)
    df = df.withColumn("__ts_days", F.when(ok, days_from_civil(t("y"), t("m"), t("d"))))
    df = df.withColumn("__ts_local", (t("days") * 86400 + t("h") * 3600 + t("i") * 60 + t("s")) * 1_000_000 + t("us"))
    n, e = F.length(F.regexp_replace(t("e"), "-", "")), t("e").try_cast("long")
    epoch = F.when(n <= 11, e * 1_000_000).when(n <= 14, e * 1_000).when(n <= 17, e).otherwise(F.floor(e.cast("decimal(20,0)") / 1000).cast("long"))
    wall = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(t("local")), t("zone")))
    value = F.when(t("e").isNotNull(), epoch).when(t("z").isNotNull(), t("local") - t("off").cast("long") * 60_000_000).when(t("zone").isNotNull(), wall)
    return df.select(*[F.col(f"`{c}`") for c in keep if c != out], value.alias(out))


def readable(df: DataFrame, out: str) -> DataFrame:
    """The rows whose `out` isn't null.

    A plain filter would be pushed below the projections, each reference
    replaced by the whole parsing expression; a predicate that also reads a
    non-deterministic column stays where it is.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*keep, F.monotonically_increasing_id().alias("__ts_here")).where((F.col("__ts_here") >= 0) & F.col(out).isNotNull()).select(*keep)
