"""Capping records per dominant contributor (problem 4).

Of each contributor a histogram of quality is built with map-side combining
(at most `BINS` + 1 rows a contributor and map task, mergeable over any split of
the input).  Running sums over a histogram give the cutoff bin in which the cap
is met; better bins stay whole, worse ones go whole, and only records of the
cutoff bin are ranked.  These are laid out by ranges of (contributor, score, tie)
and counted per range: again only the range in which the cap falls is ranked, by
row numbers on top of the counts before it.  So a contributor with a third of all
rows, even with one tied score, is never sorted in one task, whatever its cap: a
count, a share of the contributor's records, or both (the smaller holds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alnum_key, is_blank
from ..session import written

BINS = 128


def quality_bin(score: Column, low: float, high: float) -> Column:
    """0 (best) to BINS - 1 over the scores' range, then BINS for null and NaN; never decreasing as the score falls."""
    width = high - low if high - low < float("inf") else high / 2 - low / 2
    share = (score - low) / width if high - low < float("inf") else (score / 2 - low / 2) / width
    at = (BINS - 1) - F.greatest(F.least(F.floor(share * BINS), F.lit(BINS - 1)), F.lit(0)) if width > 0 else F.lit(0)
    at = F.when(score == float("inf"), 0).when(score == float("-inf"), BINS - 1).otherwise(at)
    return F.when(score.isNull() | F.isnan(score), BINS).otherwise(at).cast("int")


def beyond_cap(
    items: DataFrame, contributor: list[str], score: str, tie: str, max_count: int | None = None, max_share: float | None = None
) -> DataFrame:
    """The rows of `items` beyond their contributor's cap, with all their columns.

    Within a contributor (the values of the `contributor` columns) rows are
    ordered by `score` from high to low, null and NaN last, then by `tie` from
    low to high.  (contributor, tie) should be unique; of rows equal in both any
    may be the last that stays.  A row with a null contributor has none and no
    cap.  An empty input gives no row.
    """
    keys = list(contributor)
    s = F.col(f"`{score}`")
    rows = written(items.withColumn("__neg", F.when(s.isNull() | F.isnan(s), float("inf")).otherwise(-s)), "items")
    finite = F.when(~s.isNull() & ~F.isnan(s) & (F.abs(s) < float("inf")), s)
    low, high = rows.agg(F.min(finite), F.max(finite)).first()
    marked = rows.withColumn("__bin", quality_bin(s, float(low or 0), float(high or 0)))
    histogram = marked.groupBy(*keys, "__bin").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    cap = F.lit(max_count).cast("bigint")
    if max_share is not None:
        by_share = F.floor(F.sum("__n").over(w) * max_share).cast("bigint")
        cap = by_share if max_count is None else F.least(cap, by_share)
    running = F.sum("__n").over(w.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))
    cut = (
        histogram.withColumn("__cap", cap)
        .withColumn("__upto", running)
        .where(F.col("__upto") > F.col("__cap"))
        .groupBy(*keys)
        .agg(F.min(F.struct("__bin", (F.col("__cap") - F.col("__upto") + F.col("__n")).alias("need"))).alias("__cut"))
        .select(*keys, F.col("__cut.__bin").alias("__cut_bin"), F.col("__cut.need").alias("__need"))
    )
    reach = written(marked.join(cut, keys).where("__bin >= __cut_bin"), "reach")
    columns = [F.col(f"`{c}`") for c in items.columns]
    whole = reach.where("__bin > __cut_bin").select(*columns)
    order = ["__neg", F.col(f"`{tie}`")]
    border = reach.where("__bin = __cut_bin").repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id())
    border = written(border, "border")
    before = F.sum("__n").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = border.groupBy(*keys, "__need", "__range").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0)))
    # Of ranges that begin before the cap and end beyond it, at most one a contributor, rows are ranked.
    ranges = ranges.where("__before + __n > __need").select(*keys, "__range", "__before")
    left = border.join(ranges, [*keys, "__range"])
    after = left.where("__before >= __need").select(*columns)
    place = F.col("__before") + F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order))
    last = left.where("__before < __need").withColumn("__place", place).where("__place > __need").select(*columns)
    return whole.unionByName(after).unionByName(last)


def latest_items(ranked_item: DataFrame) -> DataFrame:
    """Of each (run_id, key) the row ranked last; equal times fall to the higher score."""
    s = F.col("relevance_score")
    when = F.struct(F.col("ranked_at").alias("t"), F.coalesce(F.nanvl(s, F.lit(None)), F.lit(float("-inf"))).alias("s"), F.col("independence_group_id").alias("g"))
    return (
        ranked_item.where(F.col("run_id").isNotNull() & F.col("key").isNotNull())
        .groupBy("run_id", "key")
        .agg(F.max_by(F.struct("independence_group_id", "relevance_score"), when).alias("r"))
        .select("run_id", "key", "r.independence_group_id", "r.relevance_score")
    )


def with_contributor(items: DataFrame, dedup_candidate: DataFrame) -> DataFrame:
    """Adds `contributor`: the group, else the outlet's name, else the item alone."""
    grouped = items.where(~is_blank(F.col("independence_group_id"))).withColumn("contributor", F.concat(F.lit("g:"), "independence_group_id"))
    names = dedup_candidate.where(~is_blank(F.col("publisher"))).select("key", F.col("publisher").alias("__name"))
    alone = items.where(is_blank(F.col("independence_group_id"))).join(names, "key", "left")
    alone = alone.withColumn("__name", alnum_key(F.col("__name")))
    alone = alone.withColumn("contributor", F.coalesce(F.concat(F.lit("p:"), "__name"), F.concat(F.lit("i:"), "key"))).drop("__name")
    return grouped.unionByName(alone)
