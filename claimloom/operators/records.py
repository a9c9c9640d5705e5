"""The nested retrieval record of each run, its lineage, and time budgets."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import python_text, tokens
from ..functions.jcs import canonical_column, canonical_json
from ..functions.text import is_blank, none_if_blank
from . import contract
from .provenance import parse_timestamp, temporal

MAX_EVIDENCE = 20
VERSIONS = {"engine": "1", "schema": contract.VERSION, "reranker": "feature-linear-1", "dedup": "simhash+jaccard-1"}


def uuid_of(text: Column) -> Column:
    """A UUID made of a text, the same on every run."""
    return F.regexp_replace(F.md5(text), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def instant_text(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def project_hits(corpus: DataFrame) -> DataFrame:
    """Adds `content_status, snippet, candidate_key` to corpus records; an unnamed kind is the local corpus."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    hashed = F.substring(F.sha2(F.concat(F.coalesce("text", F.lit("")), F.coalesce("title", F.lit(""))), 256), 1, 32)
    key = F.when(some("id"), F.concat(F.lit("corpus:"), "id")).when(some("url"), F.concat(F.lit("url:"), "url")).otherwise(F.concat(F.lit("text:"), hashed))
    status = F.when(some("text"), "full").when(some("title"), "snippet_only").otherwise("unavailable")
    made = {"content_status": status, "snippet": F.substring("text", 1, 300), "candidate_key": key, "kind": F.coalesce("kind", F.lit("local_corpus"))}
    return corpus.withColumns(made)


def content_status(said: Column, text: Column) -> Column:
    """The status a spelling stands for; a blank text is unavailable whatever was promised, an unknown spelling an excerpt."""
    s = F.regexp_replace(F.lower(F.trim(said)), r"[\s_-]+", "_")
    return F.when(is_blank(text), "unavailable").when(s.isin("full", "excerpt_only", "snippet_only"), s).otherwise("excerpt_only")


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Of each key the latest row, equal times by the greatest row: one aggregation, no window."""
    rest = [c for c in rows.columns if c not in keys]
    row = F.struct(*rest)
    return rows.groupBy(*keys).agg(F.max_by(row, F.struct(at, F.xxhash64(*rest))).alias("__r")).select(*keys, "__r.*")


def evidence(items: DataFrame, candidates: DataFrame, groups: DataFrame, runs: DataFrame, raw: bool = False) -> DataFrame:
    """`run_id, place, evidence`: the best `MAX_EVIDENCE` items of each run as records of the contract.

    Values that break the contract are mended (a language that is no tag, a date
    without an offset, an unknown score), or left as they came with `raw`.
    """
    ranked = latest(items.where("run_id is not null and key is not null").select("run_id", "key", "relevance_score", "credibility", "fusion_score", "ranked_at"), ["run_id", "key"], "ranked_at")
    order = [F.desc(F.coalesce(F.nanvl("relevance_score", F.lit(None).cast("double")), F.lit(float("-inf")))), "key"]
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(*order))).where(F.col("place") <= MAX_EVIDENCE)
    columns = ["title", "text", "url", "publisher", "language", "published_at", "provider", "kind", "content_status", "discovery_method", "retrieved_at"]
    found = latest(candidates.select("run_id", "key", *columns), ["run_id", "key"], "retrieved_at")
    named = groups.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("duplicate_cluster_id").alias("dc"), F.min("independence_group_id").alias("ig"))
    df = ranked.join(found, ["run_id", "key"], "left").join(named, "key", "left").join(runs.select("run_id", "as_of", "case_id"), "run_id")
    df = temporal(df, "published_at", F.to_timestamp("as_of")).withColumn("text", F.when(is_blank(F.col("text")), "").otherwise(F.col("text")))
    alone = lambda p: F.concat(F.lit(p), F.substring(F.sha2("key", 256), 1, 24))
    tag = F.col("language").rlike("^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$")
    dated = F.date_format(parse_timestamp(F.col("published_at")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    score = F.nanvl("relevance_score", F.lit(None).cast("double"))
    none = lambda kind: F.lit(None).cast(kind)
    pick = lambda mended, as_is: F.col(as_is) if raw else mended
    excerpt = python_text.excerpts(F.col("text"), F.array_distinct(tokens.content_tokens(F.col("title"))))
    record = F.struct(
        F.concat(F.lit("ev_"), F.md5("run_id"), F.format_string("_%06d", "place")).alias("evidence_id"), F.array().cast("array<string>").alias("atom_ids"),
        F.struct(
            F.coalesce("provider", F.lit("unknown")).alias("provider"), pick(F.coalesce("kind", F.lit("web")), "kind").alias("kind"), pick(none_if_blank(F.col("url")), "url").alias("url"), F.coalesce("title", F.lit("")).alias("title"),
            pick(none_if_blank(F.col("publisher")), "publisher").alias("publisher"), pick(F.when(tag, F.col("language")), "language").alias("language"), pick(dated, "published_at").alias("published_at"),
            F.coalesce(instant_text(F.col("retrieved_at")), F.lit("1970-01-01T00:00:00Z")).alias("retrieved_at"),
        ).alias("source"),
        F.struct("text", excerpt.alias("excerpt"), F.sha2("text", 256).alias("sha256"), pick(content_status(F.col("content_status"), F.col("text")), "content_status").alias("status")).alias("content"),
        F.struct(
            none_if_blank(F.col("url")).alias("original_url"), none("string").alias("archive_url"), none("string").alias("first_seen_at"), none("string").alias("captured_at"), "date_basis",
            F.coalesce("discovery_method", F.lit("unknown")).alias("discovery_method"), F.coalesce(none_if_blank(F.col("dc")), alone("dc_")).alias("duplicate_cluster_id"), F.coalesce(none_if_blank(F.col("ig")), alone("ig_")).alias("independence_group_id"),
            "temporal_eligible", F.when(score.isNull(), "relevance unknown").alias("usage_note"),
            F.array().cast("array<struct<asset_id:string,matched_url:string,match_type:string,score:double>>").alias("image_matches"),
        ).alias("provenance"),
        pick(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0)))), "relevance_score").alias("relevance_score"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl("credibility", none("double")))).alias("credibility_score"), none("double").alias("rerank_score"),
        F.create_map(F.lit("fusion_rrf"), F.coalesce(F.nanvl("fusion_score", F.lit(0.0)), F.lit(0.0))).alias("score_breakdown"),
    )
    return df.select("run_id", "place", record.alias("evidence"))


def roll_up(runs: DataFrame, items: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """`run_id, retrieval` of every run (K16): partial unless it ended whole, a warning where a whole run found nothing.

    A run holds at most `MAX_EVIDENCE` items and a signal or two, so its lists are small.
    """
    lists = items.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("place", "evidence")), lambda a, b: a["place"] - b["place"]).alias("e"))
    df = runs.join(lists, "run_id", "left").withColumn("evidence_list", F.transform(F.coalesce("e", F.array().cast(dict(lists.dtypes)["e"])), lambda x: x["evidence"]))
    if signals is None:
        df = df.withColumn("forensic_signals", F.array().cast("array<string>"))
    else:
        told = signals.groupBy("run_id").agg(F.array_sort(F.collect_list("signal"), lambda a, b: F.when(a["signal_id"] < b["signal_id"], -1).otherwise(1)).alias("s"))
        df = df.join(told, "run_id", "left").withColumn("forensic_signals", F.coalesce("s", F.array().cast(dict(told.dtypes)["s"])))
    status = F.when(F.col("status") == "completed", "completed").otherwise("partial")
    empty = (F.size("evidence_list") == 0) & (status == "completed")
    told = F.struct(F.lit("NO_EVIDENCE_FOUND").alias("code"), F.lit("no active source had evidence; that is neither for nor against the claim").alias("message"), F.lit("retrieval").alias("component"))
    at = instant_text(F.col("created_at"))
    run = F.struct(
        uuid_of(F.col("run_id")).alias("run_id"), F.col("mode"), at.alias("started_at"), at.alias("finished_at"), status.alias("status"), F.create_map(*[F.lit(x) for kv in VERSIONS.items() for x in kv]).alias("versions"),
        F.when(empty, F.array(told)).otherwise(F.array().cast("array<struct<code:string,message:string,component:string>>")).alias("warnings"),
    )
    empty_rows = F.array().cast("array<string>")
    retrieval = F.struct(run.alias("run"), F.lit(None).cast("string").alias("atom_set_id"), "evidence_list", "forensic_signals", empty_rows.alias("query_log"), empty_rows.alias("provider_status"))
    return df.select("run_id", retrieval.alias("retrieval"))


def bundles(runs: DataFrame, retrievals: DataFrame, claim_text: str, language: str = "id") -> DataFrame:
    """`run_id, bundle`: whole records as JSON text, with the lineage of each run among the extensions."""
    df = runs.join(retrievals, "run_id")
    none = F.lit(None).cast("string")
    claim = F.coalesce(F.col(claim_text), F.lit(""))
    snapshot = F.to_json(F.struct("case_id", "claim_revision", F.sha2(claim, 256).alias("claim_text_sha256"), none.alias("image_sha256"), none.alias("atom_set_id")), {"ignoreNullFields": "false"})
    lineage = F.struct(F.array().cast("array<string>").alias("parent_run_ids"), F.sha2(canonical_column(snapshot), 256).alias("input_snapshot_sha256"), F.lit(config_hash()).alias("config_hash"))
    text = F.to_json(
        F.struct(
            F.lit(contract.VERSION).alias("schema_version"), uuid_of(F.col("case_id")).alias("case_id"), "claim_revision", "mode", instant_text(F.col("created_at")).alias("created_at"),
            F.struct(claim.alias("claim_text"), F.lit(language).alias("language"), none.alias("image"), instant_text(F.col("as_of")).alias("as_of")).alias("input"), none.alias("analysis"), "retrieval", none.alias("decision"),
            F.array().cast("array<string>").alias("warnings"), F.create_map(F.lit("run_inputs"), lineage).alias("extensions"),
        ),
        {"ignoreNullFields": "false"},
    )
    return df.select("run_id", text.alias("bundle"))


def config_hash(settings: dict | None = None) -> str:
    """The hash of a run's settings in canonical form."""
    return hashlib.sha256(canonical_json({"max_evidence": MAX_EVIDENCE, **VERSIONS, **(settings or {})}).encode()).hexdigest()


def within_budget(log: DataFrame, run: str, order: list[str], seconds: str, budget: float = 45.0) -> DataFrame:
    """Adds `spent, executed, run_status` (D7): a step runs if the time before it is below the budget; a run that lost a step is partial.

    A run's log is bounded by its queries times its providers.
    """
    w = Window.partitionBy(run)
    spent = F.coalesce(F.sum(F.coalesce(F.col(seconds), F.lit(0.0))).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    df = log.withColumn("spent", F.round(spent, 6)).withColumn("executed", F.col("spent") < budget)
    return df.withColumn("run_status", F.when(F.bool_and("executed").over(w), "completed").otherwise("partial"))
