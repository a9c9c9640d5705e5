"""The one UTC instant of every record with a readable date (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import DIGIT, normalize_timestamps, readable
from .publishers import with_publisher


def record_instants(records: DataFrame, publishers: DataFrame, dedup_candidate: DataFrame | None, row_id: str = "rec_id", key: str = "id") -> DataFrame:
    """`row_id, utc_us` of every record whose `published_at` names an instant.

    Records without a readable date, and those without a zone whose outlet is
    unknown, give no row.  Null columns count as absent; repeated rows give one
    row each.  Only the four columns needed are read.
    """
    df = records.select(F.col(row_id), F.col(key).alias("__k"), F.col("publisher"), F.col("published_at"))
    df = df.where(F.col("published_at").rlike(DIGIT))
    df = with_publisher(df, publishers, dedup_candidate, "__k", "publisher")
    df = normalize_timestamps(df, "published_at", "utc_us", F.col("__pub_zone"), F.col("__pub_order"))
    return readable(df.select(row_id, "utc_us"), "utc_us")
