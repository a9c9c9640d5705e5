"""Query planning: one claim to a few ordered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import PLAN_STOPS, raw_tokens

# Cue words added to the fact-check query (fixed value).
FACT_CHECK_SUFFIX = "fakta OR hoaks OR klarifikasi"


def keywords(text: Column, limit: int = 8) -> Column:
    """The first distinct tokens, case kept, of three letters or more that aren't function words."""
    stops = F.array(*map(F.lit, PLAN_STOPS))
    kept = F.filter(raw_tokens(text), lambda x: (F.length(x) >= 3) & ~F.array_contains(stops, F.lower(x)))
    return F.slice(F.array_distinct(kept), 1, limit)


def plan_queries(claims: DataFrame, claim: str, text: str, atoms: str | None = None) -> DataFrame:
    """`claim, query_id, query, variation, atom_ids`, one row per planned query.

    In order: the caption, its keywords, the fact-check form, then one query per
    atom of the optional array<struct<atom_id, statement>> column `atoms`.
    Blank queries and repeats of (query, variation) are left out before numbering.
    """
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)^\s+|\s+$", "")
    none = F.array().cast("array<string>")
    entry = lambda q, v, a=none: F.struct(q.alias("query"), F.lit(v).alias("variation"), a.alias("atom_ids"))
    df = claims.withColumn("__kw", keywords(F.col(text)))
    some = F.size("__kw") > 0
    planned = F.array(
        entry(trimmed, "caption"),
        entry(F.when(some, F.array_join("__kw", " ")), "entity"),
        entry(F.when(some, F.concat_ws(" ", F.array_join(F.slice("__kw", 1, 5), " "), F.lit(FACT_CHECK_SUFFIX))), "fact_check"),
    )
    if atoms:
        own = F.transform(
            F.coalesce(F.col(atoms), F.array().cast("array<struct<atom_id:string,statement:string>>")),
            lambda a: entry(F.trim(a["statement"]), "atom", F.array_compact(F.array(a["atom_id"]))),
        )
        planned = F.concat(planned, own)
    df = df.withColumn("__q", F.filter(planned, lambda q: q["query"].isNotNull() & (q["query"] != "")))
    first = F.filter(
        F.transform("__q", lambda q, i: F.struct(q.alias("q"), i.alias("i"))),
        lambda x: ~F.exists(F.slice(F.col("__q"), F.lit(1), x["i"]), lambda o: (o["query"] == x["q"]["query"]) & (o["variation"] == x["q"]["variation"])),
    )
    rows = df.select(F.col(claim), F.posexplode(first).alias("n", "x"))
    return rows.select(
        claim, F.concat(F.lit("q"), F.lpad((F.col("n") + 1).cast("string"), 3, "0")).alias("query_id"), "x.q.query", "x.q.variation", "x.q.atom_ids", (F.col("n") + 1).alias("query_seq")
    )
