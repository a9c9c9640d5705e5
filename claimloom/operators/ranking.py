"""Reranking by a transparent linear model, diversification and diversity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import content_tokens, jaccard, match_tokens, shingles
from ..session import written

# Weights of the linear model (fixed values).
WEIGHTS = {
    "query_coverage": 2.4, "title_match": 0.9, "body_overlap": 1.2, "fusion_prior": 1.1, "content_completeness": 0.8, "credibility": 0.6,
    "image_match": 0.7, "temporal_eligible": 0.5, "temporal_ineligible_penalty": -1.4, "unknown_date_penalty": -0.3, "bias": -1.5,
}
# Completeness of each content status for reranking (fixed values).
COMPLETENESS = {"full": 1.0, "excerpt_only": 0.6, "snippet_only": 0.3, "unavailable": 0.0}
MMR_LAMBDA, GROUP_CAP, MAX_EVIDENCE = 0.7, 2, 20


def feature_columns(items: DataFrame, claim: str, query: str, title: str = "title", text: str = "text") -> DataFrame:
    """Adds the eleven features as `f_*` columns (H2).

    Needs `fusion_score, content_status, credibility, temporal_eligible` and
    optionally `has_image_match`; missing credibility counts 0.5.
    """
    q = F.array_distinct(content_tokens(F.col(query)))
    df = items.withColumn("__q", q).withColumn("__t", F.array_distinct(match_tokens(F.col(title)))).withColumn("__b", content_tokens(F.col(text)))
    share = lambda doc: F.when(F.size("__q") > 0, F.size(F.array_intersect("__q", doc)) / F.size("__q")).otherwise(0.0)
    top = F.max("fusion_score").over(Window.partitionBy(claim))
    status = F.create_map(*[F.lit(x) for kv in COMPLETENESS.items() for x in kv])
    eligible = F.col("temporal_eligible")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    made = {
        "query_coverage": share(F.array_union("__b", "__t")),
        "title_match": share(F.col("__t")),
        "body_overlap": jaccard(shingles(content_tokens(F.col(query)), 2), shingles(F.col("__b"), 2)),
        "fusion_prior": F.when(top > 0, F.col("fusion_score") / top).otherwise(0.0),
        "content_completeness": F.coalesce(F.element_at(status, F.coalesce("content_status", F.lit(""))), F.lit(0.0)),
        "credibility": F.coalesce("credibility", F.lit(0.5)),
        "image_match": flag(F.coalesce("has_image_match", F.lit(False))) if "has_image_match" in items.columns else F.lit(0.0),
        "temporal_eligible": flag(eligible),
        "temporal_ineligible_penalty": flag(~eligible),
        "unknown_date_penalty": flag(eligible.isNull()),
        "bias": F.lit(1.0),
    }
    return df.withColumns({f"f_{k}": v for k, v in made.items()}).drop("__q", "__t", "__b")


def rerank(items: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds `rerank_score`, `relevance_score` and the map `score_breakdown` (H3-H5), with the terms of `credibility_parts` where there are any."""
    active = WEIGHTS | (weights or {})
    given = {k: F.round(F.lit(w) * F.col(f"f_{k}"), 6) for k, w in active.items()}
    total = sum(given.values(), F.lit(0.0))
    parts = [x for k in active for x in (F.lit(f"feature.{k}"), F.round(f"f_{k}", 6), F.lit(f"contribution.{k}"), given[k])]
    df = items.withColumn("__s", total).withColumn("score_breakdown", F.create_map(*parts, F.lit("fusion_rrf"), F.round("fusion_score", 6)))
    if "credibility_parts" in items.columns:
        credit = F.transform_keys("credibility_parts", lambda k, v: F.concat(F.lit("credibility."), k))
        df = df.withColumn("score_breakdown", F.map_concat("score_breakdown", F.coalesce(credit, F.create_map().cast("map<string,double>"))))
    return df.withColumn("rerank_score", F.round("__s", 6)).withColumn("relevance_score", F.round(1 / (1 + F.exp(-F.col("__s"))), 6)).drop("__s")


def strongest(breakdown: F.Column, n: int = 3) -> F.Column:
    """Names of the features that moved a score most, the bias apart (H7)."""
    entries = F.filter(F.map_entries(breakdown), lambda e: e["key"].startswith("contribution.") & (e["key"] != "contribution.bias") & (F.abs(e["value"]) > 1e-9))
    keyed = F.array_sort(F.transform(entries, lambda e: F.struct(-F.abs(e["value"]), F.substring(e["key"], 14, 100))))
    return F.transform(F.slice(keyed, 1, n), lambda e: e["col2"])


def reasons(breakdown: F.Column) -> F.Column:
    """Why an item ranks as it does (H7): codes by the features' limits, then the strongest features."""
    f = lambda k: F.coalesce(breakdown[f"feature.{k}"], F.lit(0.0))
    told = F.array(
        F.when(f("query_coverage") >= 0.6, "covers_claim").when(f("query_coverage") <= 0.2, "covers_little"), F.when(f("title_match") >= 0.5, "title_matches"), F.when(f("content_completeness") <= 0.3, "content_limited"),
        F.when(f("image_match") > 0, "image_matches"), F.when(f("temporal_ineligible_penalty") > 0, "after_cutoff"), F.when(f("unknown_date_penalty") > 0, "date_unknown"),
    )
    top = strongest(breakdown)
    return F.concat(F.array_compact(told), F.when(F.size(top) > 0, F.array(F.concat(F.lit("strongest:"), F.array_join(top, "+")))).otherwise(F.array().cast("array<string>")))


def diversify(items: DataFrame, claim: str, key: str, group: str, order: str, text: str, limit: int = MAX_EVIDENCE, lam: float = MMR_LAMBDA, cap: int | None = GROUP_CAP) -> DataFrame:
    """`claim, key, place, selected`: greedy choice of relevant, unlike items, at most `cap` of a group (H8, H9).

    A claim's pool is bounded by its queries times the hits per query, so each
    pool fits one task.  Once everything left is over the cap, or `limit` is
    reached, the rest follows by relevance.  Equals fall to the earlier `order`.
    """
    pool = items.select(F.col(claim).cast("string").alias("c"), F.col(key).cast("string").alias("k"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), F.coalesce("relevance_score", F.lit(0.0)).alias("r"), F.col(order).cast("long").alias("o"), F.array_distinct(content_tokens(F.col(text))).alias("toks"))

    def choose(table):  # noqa: ANN001, ANN202
        rows = sorted(table.to_pylist(), key=lambda x: x["o"])
        sets = [set(x["toks"] or ()) for x in rows]
        left, near, used, out = list(range(len(rows))), [0.0] * len(rows), {}, []
        while left and len(out) < limit:
            open_ = [i for i in left if cap is None or used.get(rows[i]["g"], 0) < cap]
            if not open_:
                break
            best = max(open_, key=lambda i: (lam * rows[i]["r"] - (1 - lam) * near[i], -i))
            left.remove(best)
            out.append(best)
            used[rows[best]["g"]] = used.get(rows[best]["g"], 0) + 1
            for i in left:
                both = len(sets[i] | sets[best])
                near[i] = max(near[i], len(sets[i] & sets[best]) / both if both else 0.0)
        chosen = len(out)
        out += sorted(left, key=lambda i: (-rows[i]["r"], i))
        names = {"c": [rows[i]["c"] for i in out], "k": [rows[i]["k"] for i in out]}
        return pa.table(names | {"place": pa.array(range(1, len(out) + 1), pa.int32()), "selected": pa.array([i < chosen for i in range(len(out))], pa.bool_())}, schema=pa.schema([("c", pa.string()), ("k", pa.string()), ("place", pa.int32()), ("selected", pa.bool_())]))

    done = pool.groupBy("c").applyInArrow(choose, "c string, k string, place int, selected boolean")
    kinds = dict(items.dtypes)
    return done.select(F.col("c").cast(kinds[claim]).alias(claim), F.col("k").cast(kinds[key]).alias(key), "place", "selected")


def source_diversity(items: DataFrame, by: list[str], group: str, provider: str) -> DataFrame:
    """Items, groups, providers and groups per item."""
    n, g = F.count("*"), F.count_distinct(F.coalesce(group, F.lit("")))
    return items.groupBy(*by).agg(n.alias("items"), g.alias("independent_groups"), F.count_distinct(F.coalesce(provider, F.lit(""))).alias("providers"), F.round(g / n, 6).alias("group_ratio"))


def judged_metrics(ranked: DataFrame, relevant: DataFrame, query: str, doc: str, k: int = 10) -> DataFrame:
    """Precision, recall, reciprocal rank and nDCG at `k` per query; `relevant` has `query, doc` once per relevant pair."""
    hit = ranked.where(F.col("rank") <= k).join(relevant.withColumn("rel", F.lit(1)), [query, doc], "left")
    got = hit.groupBy(query).agg(
        F.sum(F.coalesce("rel", F.lit(0))).alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.coalesce("rel", F.lit(0)) / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    total = relevant.groupBy(query).agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda a, x: a + x)
    df = total.join(got, query, "left").withColumn("ideal", ideal)
    h = F.coalesce("hits", F.lit(0))
    return df.select(query, F.round(h / k, 6).alias("precision"), F.round(h / F.col("n"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("ideal"), 6).alias("ndcg"))


def dense_neighbours(vectors: DataFrame, queries: DataFrame, row_id: str, vector: str, k: int = 10, block: int = 20_000) -> DataFrame:
    """`query, row_id, similarity, rank`: cosine neighbours of a stated query set against all rows, itself left out.

    Queries go out in blocks of at most `block` vectors, one round each, so what
    is broadcast has a fixed bound; a round multiplies a batch of rows by its block
    in numpy, and each task keeps `k` rows a query, so little is shuffled.  Equal
    similarities (6 places) fall to the smaller id.  Null vectors match nothing.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(row_id).cast("bigint").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    asked = written(queries.where(F.col(vector).isNotNull()).select(F.col(row_id).cast("bigint").alias("q"), F.col(vector).cast("array<double>").alias("v")), "queries")
    n = asked.count()
    rounds = max(1, -(-n // block))
    found = None
    for r in range(rounds):
        own = asked if rounds == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(rounds)) == r)
        got = sorted((x["q"], x["v"]) for x in own.collect())
        sent = spark.sparkContext.broadcast((np.array([q for q, _ in got], np.int64), _unit(np.array([v for _, v in got], np.float64))))
        part = rows.mapInArrow(_best_of(sent, k), "query bigint, i bigint, s bigint")
        if rounds > 1:  # a round ends before the next block is sent
            part = written(part, "neighbours")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query").orderBy(F.desc("s"), "i")
    kept = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return kept.select("query", F.col("i").alias(row_id), F.round(F.col("s") / 1e6, 6).alias("similarity"), "rank")


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero vectors stay zero."""
    if not len(v):
        return np.zeros((0, 1))
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _best_of(sent: object, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = sent.value
        none = -(10**9)  # below any similarity
        score, best = np.full((len(ids), 0), none), np.full((len(ids), 0), 0)
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            own = b.column(0).to_numpy()
            own_unit = _unit(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1))
            s = np.floor(unit @ own_unit.T * 1e6 + 0.5).astype(np.int64)
            s[ids[:, None] == own] = none
            # The best so far and this batch together, by score, then by id.
            score, best = np.concatenate([score, s], 1), np.concatenate([best, np.broadcast_to(own, s.shape)], 1)
            if score.shape[1] > k:
                order = np.lexsort((best, -score), axis=1)[:, :k]
                score, best = np.take_along_axis(score, order, 1), np.take_along_axis(best, order, 1)
        at = np.nonzero(score > none)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at[0]]), pa.array(best[at]), pa.array(score[at])], names=["query", "i", "s"])

    return scan
