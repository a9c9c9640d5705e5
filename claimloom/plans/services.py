"""Queries of the detector branch, retrieval records and service projections, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redaction
from ..operators import contract, detectors, ranking, records, store
from ..session import table, written
from .core import _FEATURES, _HITS, _TRIM, QUERIES, SQL, _ranked, query

__all__ = ["QUERIES", "SQL"]

_SALT_TEXT, _SALT_IMAGE = "claimloom-text-detector|", "claimloom-image-detector|"
PROFILE = {"min_characters": 120, "max_characters": 2500, "languages": ["en", "de-DE"]}
_SCORE = lambda salt, x: f"round(CAST('0x' || substr(sha256('{salt}' || {x}), 1, 8) AS BIGINT) / 4294967295.0e0, 6)"
_VERDICT = lambda ok, s: f"CASE WHEN NOT ({ok}) THEN 'not_assessed' WHEN {s} >= 0.75e0 THEN 'likely_ai_generated' WHEN {s} <= 0.25e0 THEN 'likely_human_or_camera' ELSE 'uncertain' END"


# --- J: detectors ------------------------------------------------------------


@query(
    f"""SELECT doc_id, 'fs_' || md5(CAST(doc_id AS VARCHAR)) || '_000001' AS signal_id, CASE WHEN e IS NULL THEN 'ok' ELSE 'unsupported' END AS status, e AS error_code, 'text' AS modality,
    CASE WHEN e IS NULL THEN s END AS raw_score, CASE WHEN e IS NULL THEN s END AS ai_generated_score, {_VERDICT('e IS NULL', 's')} AS assessment, CASE WHEN e IS NULL THEN 2 ELSE 1 END AS n_limitations FROM
    (SELECT doc_id, CASE WHEN length(t) < 120 THEN 'TEXT_TOO_SHORT' WHEN length(t) > 2500 THEN 'TEXT_TOO_LONG' WHEN coalesce(lower(regexp_extract(lang, '^[^-_]*')), '') NOT IN ('en', 'de') THEN 'LANGUAGE_NOT_SUPPORTED' END AS e,
    {_SCORE(_SALT_TEXT, 't')} AS s FROM (SELECT doc_id, lang, {_TRIM} AS t FROM documents WHERE text IS NOT NULL))"""
)
def built_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals of the text detector over all documents with a text: gates, outcome, target, scale and verdict."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", "lang")
    told = detectors.fixture_text_signals(docs, "text", F.col("lang"), _SALT_TEXT, PROFILE).withColumn("raw_score", F.col("ai_score"))
    built = detectors.build_signals(
        told, F.md5(F.col("doc_id").cast("string")), F.lit(1), "demo_fixture_text", F.lit("claim_text"), F.lit(None).cast("string"), F.sha2("text", 256), (0.0, 1.0, True), ["a fixture", "a fixture"], "fixture-text-1"
    )
    s = F.col("signal")
    names = ["signal_id", "status", "error_code", "modality", "raw_score", "ai_generated_score", "assessment"]
    return built.select("doc_id", *[s[n].alias(n) for n in names], F.size(s["limitations"]).alias("n_limitations"))


@query(
    f"""SELECT doc_id, CASE WHEN e IS NULL THEN 'ok' WHEN e = 'IMAGE_UNREADABLE' THEN 'failed' ELSE 'unsupported' END AS status, e AS error_code, CASE WHEN e IS NULL THEN s END AS ai_score, {_VERDICT('e IS NULL', 's')} AS assessment FROM
    (SELECT doc_id, CASE WHEN coalesce(n_chars, 0) < 64 OR coalesce(n_chars, 0) + 10 < 64 THEN 'IMAGE_TOO_SMALL' WHEN coalesce(text, '') = '' THEN 'IMAGE_UNREADABLE' END AS e, {_SCORE(_SALT_IMAGE, "coalesce(text, '')")} AS s FROM documents)"""
)
def image_signals(spark: SparkSession, d: str) -> DataFrame:
    """The image detector over the bytes of all documents, their lengths as sizes in pixels."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"), F.col("n_chars").alias("width"), (F.col("n_chars") + 10).alias("height"))
    return detectors.fixture_image_signals(docs, "data", "width", "height", _SALT_IMAGE).select("doc_id", "status", "error_code", "ai_score", "assessment")


@query("SELECT * FROM (VALUES ('image_detector_disabled', 'image_ai_detection', 'disabled'), ('demo_fixture_text', 'text_ai_detection', 'unconfigured'), ('vendor', 'image_ai_detection', 'ok'), ('half', 'text_ai_detection', 'unconfigured')) t(provider, capability, status)")
def detector_registry(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of chosen detectors in a live run: off, a fixture, a whole profile, one without a scale."""
    whole = {"modality": "image", "endpoint": "https://vendor.test", "score_path": "score", "scale": {"min": 0, "max": 1, "higher_means_ai": True}, "required_config": ["key"]}
    profiles, keys = {"image:vendor": whole, "text:half": {"modality": "text", "endpoint": "https://half.test", "score_path": "s"}}, {"key": "k"}
    pairs = [("none", "fixture"), ("vendor", "half")]
    one, two = (detectors.capability_report(spark, image, text, "live", profiles, keys) for image, text in pairs)
    return one.unionByName(two).select("provider", "capability", "status")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN '<redacted>' ELSE 'agent ' || CAST(user_id AS VARCHAR) END AS kept, '{\"items\":[{\"Token\":\"<redacted>\"}],\"user\":' || CAST(user_id AS VARCHAR) || '}' AS body FROM events")
def redacted(spark: SparkSession, d: str) -> DataFrame:
    """Secrets taken out of headers and of nested bodies made from the events."""
    name = F.when(F.col("event_type") == "click", "Authorization").otherwise("User-Agent")
    headers = redaction.redact_headers(F.create_map(name, F.concat(F.lit("agent "), F.col("user_id").cast("string"))))
    body = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("Token"))).alias("items"), F.col("user_id").alias("user")))
    return table(spark, d, "events").select("event_id", F.map_values(headers)[0].alias("kept"), redaction.redact_json(body).alias("body"))


@query("SELECT key, duplicate_cluster_id, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]), ',') AS merged FROM (SELECT key, duplicate_cluster_id, list_concat(coalesce(grouping_basis, []), coalesce(duplicate_of, []), coalesce(grouping_basis, [])) AS l FROM group_assignment)")
def merged_lists(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    basis, of = F.coalesce("grouping_basis", none), F.coalesce("duplicate_of", none)
    return table(spark, d, "group_assignment").select("key", "duplicate_cluster_id", F.array_join(detectors.stable_distinct(F.concat(basis, of, basis)), ",").alias("merged"))


# --- H: reasons --------------------------------------------------------------


@query(
    f"""WITH {_HITS}, {_FEATURES}, k AS (SELECT item_id, doc_id, query_coverage, title_match, list_sort(list_filter([{{'a': -abs(round(2.4e0 * query_coverage, 6)), 'n': 'query_coverage'}}, {{'a': -abs(round(0.9e0 * title_match, 6)), 'n': 'title_match'}},
    {{'a': -abs(round(1.2e0 * body_overlap, 6)), 'n': 'body_overlap'}}, {{'a': -abs(round(1.1e0 * fusion_prior, 6)), 'n': 'fusion_prior'}}, {{'a': -0.8e0, 'n': 'content_completeness'}}, {{'a': -0.3e0, 'n': 'credibility'}}, {{'a': -0.3e0, 'n': 'unknown_date_penalty'}}], lambda e: e.a < -1e-9)) AS t FROM sc)
    SELECT item_id, doc_id, array_to_string(list_filter([CASE WHEN round(query_coverage, 6) >= 0.6e0 THEN 'covers_claim' WHEN round(query_coverage, 6) <= 0.2e0 THEN 'covers_little' END, CASE WHEN round(title_match, 6) >= 0.5e0 THEN 'title_matches' END, 'date_unknown',
    'strongest:' || array_to_string(list_transform(list_slice(t, 1, 3), lambda e: e.n), '+')], lambda x: x IS NOT NULL), ',') AS reasons FROM k"""
)
def ranking_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("item_id", "doc_id", F.array_join(ranking.reasons(F.col("score_breakdown")), ",").alias("reasons"))


# --- D, K: records, lineage, service projections -----------------------------

_LATEST = "SELECT run_id, key FROM ranked_item WHERE run_id IS NOT NULL AND key IS NOT NULL GROUP BY ALL"


def _bundles(spark: SparkSession, d: str, raw: bool) -> DataFrame:
    runs = table(spark, d, "retrieval_runs")
    items = records.evidence(*(table(spark, d, t) for t in ("ranked_item", "candidate", "group_assignment")), runs, raw)
    return records.bundles(runs, records.roll_up(runs, items), "case_id")


@query(
    f"""SELECT run_id, CASE WHEN status = 'completed' THEN 'completed' ELSE 'partial' END AS status, least(coalesce(n, 0), 20) AS n_evidence, CASE WHEN n > 0 THEN 'ev_' || md5(run_id) || '_000001' END AS first_evidence,
    CASE WHEN n IS NULL AND status = 'completed' THEN 1 ELSE 0 END AS n_warnings, CAST(0 AS BIGINT) AS n_violations FROM retrieval_runs LEFT JOIN (SELECT run_id, count(*) AS n FROM ({_LATEST}) GROUP BY run_id) USING (run_id)"""
)
def retrieval_records(spark: SparkSession, d: str) -> DataFrame:
    """Whole records of all runs, checked against the contract: mended values break none of its rules."""
    made = written(_bundles(spark, d, raw=False), "bundles")
    found = contract.validate(made, "run_id", "bundle").groupBy("row_id").agg(F.count("*").alias("n"))
    b = F.parse_json("bundle")
    get = lambda path, kind: F.variant_get(b, path, kind)
    shown = made.select(
        "run_id", get("$.retrieval.run.status", "string").alias("status"), F.size(get("$.retrieval.evidence_list", "array<variant>")).cast("bigint").alias("n_evidence"),
        F.try_variant_get(b, "$.retrieval.evidence_list[0].evidence_id", "string").alias("first_evidence"), F.size(get("$.retrieval.run.warnings", "array<variant>")).alias("n_warnings"),
    )
    return shown.join(found, shown["run_id"] == found["row_id"], "left").select(*shown.columns, F.coalesce("n", F.lit(0)).alias("n_violations"))


@query()
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of the same records with their values as they came."""
    found = contract.validate(_bundles(spark, d, raw=True), "run_id", "bundle")
    return found.withColumnRenamed("row_id", "run_id").select("run_id", "code", "path")


@query("SELECT event_id, event_type, spent, spent < 45 AS executed, CASE WHEN bool_and(spent < 45) OVER (PARTITION BY user_id, day) THEN 'completed' ELSE 'partial' END AS run_status FROM (SELECT *, round(coalesce(sum(coalesce(value, 0)) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS spent FROM (SELECT *, CAST(ts AS DATE) AS day FROM events))")
def budgeted_runs(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user's day as the steps of a run, their values as seconds."""
    log = table(spark, d, "events").withColumn("run", F.struct("user_id", F.to_date("ts")))
    return records.within_budget(log, "run", ["ts", "event_id"], "value").select("event_id", "event_type", "spent", "executed", "run_status")


_STATUS = "CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'partial' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'queued' END"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"purchase": "succeeded", "signup": "partial", "error": "failed", "view": "running"}
    e = table(spark, d, "events")
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")), F.lit("queued"))
    return e.withColumn("status", status)


@query(f"SELECT event_id, s AS status, CASE WHEN s IN ('succeeded', 'partial') THEN props END AS result, CASE WHEN s = 'failed' THEN event_type END AS error FROM (SELECT *, {_STATUS} AS s FROM events)")
def poll_projection(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d).withColumn("result", F.col("props")).withColumn("error", F.col("event_type"))
    return store.polled(jobs, "status", "result", "error").select("event_id", "status", "result", "error")


@query(f"SELECT count(*) FILTER (WHERE s IN ('queued', 'running')) AS pending, CAST(20 AS INTEGER) AS max_pending, count(*) FILTER (WHERE s IN ('queued', 'running')) >= 20 AS refused FROM (SELECT {_STATUS} AS s FROM events)")
def backpressure(spark: SparkSession, d: str) -> DataFrame:
    return store.backpressure(_jobs(spark, d), "status")


@query(f"SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS INTEGER) AS place, 'running' AS status, CAST(user_id % 3 AS BIGINT) + 1 AS attempts, TIMESTAMP '2025-01-01 00:03:00' AS lease_expires_at FROM events WHERE {_STATUS} = 'queued' ORDER BY ts, event_id LIMIT 20")
def claimed_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d).withColumn("attempts", F.col("user_id") % 3)
    return store.claimed(jobs, "ts", "event_id", 20, F.lit("2025-01-01").cast("timestamp_ntz")).select("event_id", "place", "status", "attempts", "lease_expires_at")


@query("SELECT CASE WHEN (SELECT count(*) FROM demo_corpus) = 0 THEN 'not_ready' ELSE 'degraded' END AS status, CASE WHEN (SELECT count(*) FROM demo_corpus) = 0 THEN 503 ELSE 200 END AS http")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    needed = table(spark, d, "demo_corpus").agg((F.count("*") > 0).alias("ok"))
    rows = [store.external_capability(p, c) for p, c in (("none", "web_search"), ("archive", "fact_check_search"), (None, "image_provenance"), ("", "dense_retrieval"))]
    return store.readiness(needed, spark.createDataFrame(rows, "provider string, capability string, status string"))


@query("SELECT rec_id, CASE WHEN length(trim(coalesce(url, ''))) = 0 THEN 'KEY_EMPTY' WHEN length(trim(url)) > 200 THEN 'KEY_TOO_LONG' END AS fault FROM demo_corpus")
def key_faults(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "demo_corpus").select("rec_id", store.key_check(F.col("url")).alias("fault"))


@query("SELECT rec_id, content_status, snippet, candidate_key, kind FROM (SELECT rec_id, CASE WHEN coalesce(text, '') <> '' THEN 'full' WHEN coalesce(title, '') <> '' THEN 'snippet_only' ELSE 'unavailable' END AS content_status, substr(text, 1, 300) AS snippet, CASE WHEN coalesce(id, '') <> '' THEN 'corpus:' || id WHEN coalesce(url, '') <> '' THEN 'url:' || url ELSE 'text:' || substr(sha256(coalesce(text, '') || coalesce(title, '')), 1, 32) END AS candidate_key, coalesce(kind, 'local_corpus') AS kind FROM demo_corpus)")
def hit_projection(spark: SparkSession, d: str) -> DataFrame:
    return records.project_hits(table(spark, d, "demo_corpus")).select("rec_id", "content_status", "snippet", "candidate_key", "kind")


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_custkey, o_orderkey LIMIT 50")
def run_history(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderdate", "o_totalprice")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return store.list_runs(o, c, ["k"], "o_orderdate", 50, "o_orderkey").select("o_orderkey", "c_name", "o_totalprice")
