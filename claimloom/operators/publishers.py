"""Resolving free spellings of an outlet's name against the list of outlets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum_key, is_blank


def with_publisher(
    df: DataFrame,
    publishers: DataFrame,
    dedup_candidate: DataFrame | None,
    key: str,
    publisher: str,
    out_zone: str = "__pub_zone",
    out_order: str = "__pub_order",
    out_key: str = "__pub_key",
    needed: Column | None = None,
) -> DataFrame:
    """Adds the outlet's home zone and date habit to each row.

    The row's own `publisher` counts unless blank, else the one that
    `dedup_candidate` has for `key`.  Names match when their letters and digits
    do.  The zone is null where no entry matches.  The list of outlets has one
    entry per outlet and is fixed in size, so it is broadcast; rows look up
    `dedup_candidate` only where their own name is blank and `needed` holds.
    """
    own = F.col(f"`{publisher}`")
    lookup = publishers.select(
        alnum_key(F.col("publisher")).alias(out_key + "_p"), F.col("time_zone").alias(out_zone), F.col("date_order").alias(out_order)
    ).dropDuplicates([out_key + "_p"])
    blank = is_blank(own)
    if dedup_candidate is not None:
        names = dedup_candidate.where(~is_blank(F.col("publisher"))).select(
            F.col("key").alias("__dc_key"), F.col("publisher").alias("__dc_publisher")
        )
        ask = F.coalesce(blank if needed is None else blank & needed, F.lit(False))
        asking = df.where(ask).join(names, F.col(f"`{key}`") == names["__dc_key"], "left").drop("__dc_key")
        # Only the rows that ask are shuffled; the others would all meet under a null key.
        df = df.where(~ask).withColumn("__dc_publisher", F.lit(None).cast("string")).unionByName(asking)
        own = F.when(blank, F.col("__dc_publisher")).otherwise(own)
    else:
        own = F.when(~blank, own)
    df = df.withColumn(out_key, alnum_key(own))
    df = df.join(F.broadcast(lookup), df[out_key] == lookup[out_key + "_p"], "left")
    return df.drop(out_key + "_p", "__dc_publisher")
