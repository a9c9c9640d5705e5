"""Best representative of each duplicate group (problem 1).

Two ways to choose, over the same prepared candidates.

`survivors` is for a trust order that is given outright: of each cluster and
field the first key of the order that has a value.  It is one aggregation of
order tuples with map-side combining, so a cluster of any size is never held in
one place.  A fixed lexicographic order cannot come out of learned weights,
which is why this is used where the order is laid down.

`truth_discovery` is for the case without a given order: it alternates between
the support of each field value (votes weighted by the sources' reliability)
and the reliability of each source (mean support of its values) until no
reliability moves, then takes the value with the highest support per field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum_key, is_blank
from ..functions.timestamps import DIGIT, normalize_timestamps
from ..operators.publishers import with_publisher
from ..session import dropped, written

# Orders of trust (fixed values).
STATUS_ORDER = ["full", "excerptonly", "snippetonly"]
KIND_ORDER = ["fact_check", "official", "news", "local_corpus", "image_provenance", "web", "user_supplied"]
#: What a claim counts by its place of content: the three of `STATUS_ORDER`, then blank or unknown (fixed values).
CONTENT_WEIGHTS = [1.0, 0.75, 0.5, 0.25]
FIELDS = ["title", "url", "publisher", "published_at"]


def _place(value: Column, order: list[str]) -> Column:
    e = F.lit(len(order))
    for i in reversed(range(len(order))):
        e = F.when(value == order[i], i).otherwise(e)
    return e.cast("int")


def latest_candidates(candidate: DataFrame) -> DataFrame:
    """One narrow row per key, of its latest delivery; texts are reduced to a flag before the shuffle."""
    status = F.regexp_replace(F.lower("content_status"), r"(?U)[\s_-]+", "")
    narrow = candidate.where(F.col("key").isNotNull()).select(
        "key", "retrieved_at", "title", "url", "publisher", "published_at", "provider",
        F.when(is_blank(F.col("text")), len(STATUS_ORDER)).otherwise(_place(F.coalesce(status, F.lit("")), STATUS_ORDER)).alias("content"),
        _place(F.coalesce("kind", F.lit("")), KIND_ORDER).alias("kind_place"),
    )
    rest = [c for c in narrow.columns if c not in ("key", "retrieved_at")]
    row = F.struct(*rest)
    # Equal times fall to the greatest row, so the choice is the same on every run.
    return narrow.groupBy("key").agg(F.max(F.struct("retrieved_at", row.alias("row"))).alias("m")).select("key", "m.row.*")


def cluster_members(group_assignment: DataFrame) -> DataFrame:
    """`duplicate_cluster_id, key` of the clusters with at least two different keys."""
    pairs = group_assignment.where(F.col("duplicate_cluster_id").isNotNull() & F.col("key").isNotNull()).select("duplicate_cluster_id", "key").distinct()
    sizes = pairs.groupBy("duplicate_cluster_id").agg(F.count("*").alias("n")).where("n >= 2").select("duplicate_cluster_id")
    return pairs.join(sizes, "duplicate_cluster_id")


def prepared(candidate: DataFrame, group_assignment: DataFrame, publishers: DataFrame, dedup_candidate: DataFrame) -> DataFrame:
    """Cluster members with their candidate fields and the instant `utc_us` (null if unreadable)."""
    rows = cluster_members(group_assignment).join(latest_candidates(candidate), "key")
    rows = with_publisher(rows, publishers, dedup_candidate, "key", "publisher", needed=F.col("published_at").rlike(DIGIT))
    rows = normalize_timestamps(rows, "published_at", "utc_us", F.col("__pub_zone"), F.col("__pub_order"))
    return rows.drop("__pub_zone", "__pub_order", "__pub_key")


def survivors(rows: DataFrame) -> DataFrame:
    """`duplicate_cluster_id, field_name, best_key`: who supplies the record and each field.

    Order: content, later date (unreadable last), kind, smaller key.  A field
    nobody has gives no row; a key without a candidate row takes no part.
    """
    order = F.struct("content", F.coalesce(-F.col("utc_us"), F.lit((1 << 63) - 1)).alias("t"), "kind_place", F.col("key").alias("k"))
    has = {"record": F.lit(True), "published_at": F.col("utc_us").isNotNull()} | {f: ~is_blank(F.col(f)) for f in ("title", "url", "publisher")}
    # The conditions are computed once, as flags, before the aggregation.
    flat = rows.select("duplicate_cluster_id", order.alias("o"), *[c.alias(f"has_{f}") for f, c in has.items()])
    best = flat.groupBy("duplicate_cluster_id").agg(*[F.min(F.when(F.col(f"has_{f}"), F.col("o"))).alias(f) for f in has])
    entries = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.k").alias("best_key")) for f in has])
    return best.select("duplicate_cluster_id", F.inline(entries)).where("best_key is not null")


def truth_discovery(rows: DataFrame, source: str = "provider", rounds: int = 200, tolerance: float = 1e-4, broadcast_sources: int = 100_000) -> DataFrame:
    """`duplicate_cluster_id, field_name, value, support, best_key` of the value most supported.

    Support is a share in (0, 1].  Ties go to the value of the first key.
    Reliabilities start at 0.8 and are smoothed by one such vote; iteration ends
    when none moves by more than `tolerance`.  If some still do after `rounds`,
    that is an error: values of an unsettled round are never returned.  Where the
    rows have a place of `content`, a vote weighs by it (`CONTENT_WEIGHTS`).
    Reliabilities, a row a source, are broadcast up to `broadcast_sources` of them,
    so that a source with a third of all claims is no hot key; beyond, sources are
    many and joined by shuffling.
    """
    values = {"title": alnum_key(F.col("title")), "url": F.col("url"), "publisher": alnum_key(F.col("publisher")), "published_at": F.col("utc_us").cast("string")}
    weight = F.element_at(F.array(*map(F.lit, CONTENT_WEIGHTS)), F.col("content") + 1) if "content" in rows.columns else F.lit(1.0)
    wide = rows.select("duplicate_cluster_id", "key", F.coalesce(F.col(source), F.lit("")).alias("source"), weight.alias("weight"), *[v.alias(f) for f, v in values.items()])
    long = wide.select("duplicate_cluster_id", "key", "source", "weight", F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS])))
    claims = written(
        long.where(~is_blank(F.col("value"))).groupBy("duplicate_cluster_id", "field_name", "value", "source").agg(F.sum("weight").alias("n"), F.min("key").alias("first_key")),
        "claims",
    )
    trust = written(claims.select("source").distinct().select("source", F.lit(0.8).alias("trust")), "trust")
    few = trust.count() <= broadcast_sources

    def supported() -> DataFrame:
        votes = claims.join(F.broadcast(trust) if few else trust, "source").groupBy("duplicate_cluster_id", "field_name", "value").agg(
            F.sum(F.col("n") * F.col("trust")).alias("w"), F.min("first_key").alias("best_key")
        )
        totals = votes.groupBy("duplicate_cluster_id", "field_name").agg(F.sum("w").alias("total"))
        return votes.join(totals, ["duplicate_cluster_id", "field_name"]).withColumn("support", F.col("w") / F.col("total"))

    for _ in range(rounds):
        s = supported().select("duplicate_cluster_id", "field_name", "value", "support")
        now = claims.join(s, ["duplicate_cluster_id", "field_name", "value"]).groupBy("source").agg(
            ((F.sum(F.col("n") * F.col("support")) + 0.8) / (F.sum("n") + 1)).alias("trust")
        )
        now = written(now, "trust")
        moved = now.join(trust.withColumnRenamed("trust", "was"), "source").agg(F.max(F.abs(F.col("trust") - F.col("was"))).alias("d")).first()["d"]
        dropped(trust)
        trust = now
        if moved is None or moved <= tolerance:
            break
    else:
        raise RuntimeError(f"reliabilities still move by {moved} after {rounds} rounds")
    ranked = supported().groupBy("duplicate_cluster_id", "field_name").agg(
        F.min(F.struct((-F.round("support", 9)).alias("s"), "best_key", "value")).alias("m")
    )
    return ranked.select("duplicate_cluster_id", "field_name", "m.value", (-F.col("m.s")).alias("support"), "m.best_key")
