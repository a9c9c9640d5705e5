"""Dates with a mandatory offset, usability at a cutoff, and credibility from metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prior of each kind of source, and weight of each content status (fixed values).
KIND_PRIORS = {"fact_check": 0.80, "official": 0.75, "news": 0.55, "local_corpus": 0.50, "web": 0.35, "image_provenance": 0.40, "user_supplied": 0.30}
OTHER_KIND = 0.30
STATUS_WEIGHT = {"full": 1.0, "excerpt_only": 0.6, "snippet_only": 0.35, "unavailable": 0.0}
_RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})$"


def parse_timestamp(text: Column) -> Column:
    """The instant of an ISO text with an offset; null for naive, date-only and other texts (G1)."""
    t = F.upper(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    iso = F.replace(F.regexp_replace(t, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2"), F.lit(","), F.lit("."))
    iso = F.regexp_replace(F.regexp_replace(iso, " ", "T"), r"(T[0-9]{2}:[0-9]{2})(?=[Z+-])", "$1:00")
    return F.when(t.rlike(_RFC3339), F.try_to_timestamp(iso))


def temporal(df: DataFrame, published: str, as_of: Column, first_seen: Column | None = None) -> DataFrame:
    """Adds `temporal_eligible` and `date_basis` (G2): null without a date, true without a cutoff, inclusive."""
    seen = F.lit(None).cast("timestamp") if first_seen is None else first_seen
    own = parse_timestamp(F.col(published))
    when = F.coalesce(own, seen)
    basis = F.when(own.isNotNull(), "source.published_at").when(seen.isNotNull(), "provenance.first_seen_at")
    usable = F.when(when.isNull(), F.lit(None).cast("boolean")).when(as_of.isNull(), True).otherwise(when <= as_of)
    return df.withColumn("temporal_eligible", usable).withColumn("date_basis", basis)


def lookup(value: Column, table: dict[str, float], other: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value), F.lit(other))


def credibility(df: DataFrame, kind: str, url: str, publisher: str, published: str, status: str) -> DataFrame:
    """Adds `credibility`, the share of checkable provenance in [0, 1], and its terms `credibility_parts`."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    parts = {
        "kind_prior": lookup(F.coalesce(F.col(kind), F.lit("")), KIND_PRIORS, OTHER_KIND),
        "has_url": F.when(some(url), 0.1).otherwise(0.0),
        "has_publisher": F.when(some(publisher), 0.1).otherwise(0.0),
        "has_date": F.when(parse_timestamp(F.col(published)).isNotNull(), 0.1).otherwise(0.0),
        "content_completeness": lookup(F.coalesce(F.col(status), F.lit("")), STATUS_WEIGHT, 0.0) * 0.2,
    }
    df = df.withColumn("credibility_parts", F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), F.round(v, 6))]))
    total = F.aggregate(F.map_values("credibility_parts"), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("credibility", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / 1.3)), 6))
