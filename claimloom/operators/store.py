"""Snapshots, idempotency, queues, readiness and their projections as table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_revisions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """`case_id, claim_revision, text_hash, action` of each incoming revision: insert, keep or conflict (K1).

    Repeats within the incoming rows count once if equal, as a conflict if not.
    """
    key = ["case_id", "claim_revision"]
    new = incoming.groupBy(*key).agg(F.min("text_hash").alias("text_hash"), F.max("text_hash").alias("__other"))
    old = existing.select(*key, F.col("text_hash").alias("__old"))
    action = F.when(F.col("text_hash") != F.col("__other"), "conflict").when(F.col("__old").isNull(), "insert").when(F.col("__old") == F.col("text_hash"), "keep").otherwise("conflict")
    return new.join(old, key, "left").select(*key, "text_hash", action.alias("action"))


def idempotent(requests: DataFrame, scope: list[str], payload_hash: str, at: str, row_id: str) -> DataFrame:
    """Adds `first_id` and `replay` (new, same or conflict) by the first request of each key (K4).

    The first requests are one aggregation with map-side combining, so a key with
    a third of all requests is never sorted in one task.
    """
    first = F.min_by(F.struct(F.col(row_id).alias("i"), F.col(payload_hash).alias("h")), F.struct(at, row_id))
    heads = requests.groupBy(*[F.col(c).alias(f"__{c}") for c in scope]).agg(first.alias("__f"))
    same = [requests[c].eqNullSafe(heads[f"__{c}"]) for c in scope]
    df = requests.join(heads, same).drop(*[f"__{c}" for c in scope])
    state = F.when(F.col("__f.i") == F.col(row_id), "new").when(F.col("__f.h").eqNullSafe(F.col(payload_hash)), "same").otherwise("conflict")
    return df.withColumn("first_id", F.col("__f.i")).withColumn("replay", state).drop("__f")


def last_state(log: DataFrame, job: str, at: str, seq: str, columns: list[str]) -> DataFrame:
    """The last event of each job, one aggregation with map-side combining (K8)."""
    return log.groupBy(job).agg(F.max_by(F.struct(*columns), F.struct(at, seq)).alias("s"), F.count("*").alias("n_events")).select(job, "s.*", "n_events")


def claim_order(queue: DataFrame, at: str, row_id: str, n: int) -> DataFrame:
    """The `n` oldest rows with their place; a top-n without a global sort (K6)."""
    top = queue.orderBy(at, row_id).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(at, row_id)))


def claimed(queue: DataFrame, at: str, row_id: str, n: int, now: F.Column, lease_seconds: int = 180) -> DataFrame:
    """The `n` oldest queued jobs as running ones, an attempt more and leased from `now` (K6)."""
    top = claim_order(queue.where(F.col("status") == "queued"), at, row_id, n)
    lease = now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_seconds))
    return top.withColumn("status", F.lit("running")).withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1).withColumn("lease_expires_at", lease)


def backpressure(jobs: DataFrame, status: str, max_pending: int = 20) -> DataFrame:
    """One row `pending, max_pending, refused`: whether the queue is full (K5)."""
    n = F.count_if(F.col(status).isin("queued", "running"))
    return jobs.agg(n.alias("pending")).withColumn("max_pending", F.lit(max_pending)).withColumn("refused", F.col("pending") >= max_pending)


def polled(jobs: DataFrame, status: str, result: str, error: str) -> DataFrame:
    """What a poll may show (K9): a result of finished runs only, an error of failed ones only."""
    show = {result: F.when(F.col(status).isin("succeeded", "partial"), F.col(result)), error: F.when(F.col(status) == "failed", F.col(error))}
    return jobs.withColumns(show)


def external_capability(provider: str | None, capability: str, built: bool = False) -> tuple[str, str, str]:
    """`(provider, capability, status)` of an optional source (K11): disabled if not chosen, unsupported if not built."""
    name = (provider or "").strip() or "none"
    return name, capability, "disabled" if name == "none" else "ok" if built else "unsupported"


def readiness(needed: DataFrame, optional: DataFrame) -> DataFrame:
    """One row `status, http` (K10): not ready without all that is needed (`ok` true), degraded if anything optional is off."""
    must = needed.agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("must"))
    may = optional.agg(F.coalesce(F.bool_and(F.col("status") == "ok"), F.lit(True)).alias("may"))
    status = F.when(~F.col("must"), "not_ready").when(~F.col("may"), "degraded").otherwise("ready")
    return must.crossJoin(F.broadcast(may)).select(status.alias("status"), F.when(F.col("must"), 200).otherwise(503).alias("http"))


def key_check(key: F.Column, longest: int = 200) -> F.Column:
    """The fault of an idempotency key (K12): empty or too long once trimmed; null for a good one."""
    n = F.char_length(F.trim(F.coalesce(key, F.lit(""))))
    return F.when(n == 0, "KEY_EMPTY").when(n > longest, "KEY_TOO_LONG")


def capped_details(violations: DataFrame, by: str, limit: int = 25) -> DataFrame:
    """`by, violation_count, truncated, violations`: the first `limit` of each (K12), kept before anything is gathered."""
    w = Window.partitionBy(by).orderBy("path", "code")
    top = violations.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit)
    listed = top.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("__r", "code", "path"))).alias("v"))
    total = violations.groupBy(by).agg(F.count("*").alias("violation_count"))
    return total.join(listed, by).select(by, "violation_count", (F.col("violation_count") > limit).alias("truncated"), F.transform("v", lambda x: F.struct(x["code"], x["path"])).alias("violations"))


_STEPS = {"queued": ["running", "failed"], "running": ["succeeded", "partial", "failed", "queued"]}


def wrong_steps(log: DataFrame, job: str, status: str, at: str, seq: str, max_attempts: int = 3) -> DataFrame:
    """Events that no job may go through (K8): a step the state machine lacks, or a run after the last attempt.

    A job's log is bounded by its attempts.
    """
    w = Window.partitionBy(job).orderBy(at, seq)
    was = F.lag(status).over(w)
    allowed = F.when(was.isNull(), F.col(status) == "queued")
    for k, after in _STEPS.items():
        allowed = allowed.when(was == k, F.col(status).isin(after))
    runs = F.count_if(F.col(status) == "running").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("was", was).withColumn("ok", F.coalesce(allowed.otherwise(False), F.lit(False))).withColumn("attempts", runs).where(~F.col("ok") | ((F.col(status) == "running") & (F.col("attempts") > max_attempts))).drop("ok")


def recover_leases(jobs: DataFrame, now: F.Column, max_attempts: int = 3) -> DataFrame:
    """Running jobs whose lease is over go back to the queue, or fail after too many attempts (K7)."""
    over = (F.col("status") == "running") & (F.col("lease_expires_at") < now)
    return jobs.withColumn("status", F.when(over, F.when(F.col("attempts") >= max_attempts, "failed").otherwise("queued")).otherwise(F.col("status")))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """Documents, undated ones and ones without an address, by kind."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return corpus.groupBy("kind").agg(F.count("*").alias("n_docs"), F.count_if(blank("published_at")).alias("undated"), F.count_if(blank("url")).alias("without_url"))


def list_runs(runs: DataFrame, revisions: DataFrame, on: list[str], at: str, limit: int = 50, tie: str | None = None, case: tuple[str, str] | None = None) -> DataFrame:
    """Newest runs with their revision (K3): inner join, for one case if asked, then a top-n."""
    both = runs.join(revisions, on)
    both = both if case is None else both.where(F.col(case[0]) == case[1])
    return both.orderBy(F.desc(at), *on, *([tie] if tie else [])).limit(limit)


def with_counts(runs: DataFrame, retrieval_json: str) -> DataFrame:
    """Adds `evidence_count, signal_count` read out of stored retrievals (K3); null text counts nothing."""
    own = F.try_parse_json(retrieval_json)
    n = lambda k: F.coalesce(F.size(F.try_variant_get(own, f"$.{k}", "array<variant>")), F.lit(0))
    return runs.withColumn("evidence_count", n("evidence_list")).withColumn("signal_count", n("forensic_signals"))



def assemble_evidence(items: DataFrame, claim: str, place: str, columns: list[str]) -> DataFrame:
    """One row per claim: its evidence in order with sequence ids.

    A claim's evidence is bounded by the number asked for, so the lists are small.
    """
    numbered = items.withColumn("evidence_id", F.format_string("ev_%06d", F.col(place).cast("int")))
    rows = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), "evidence_id", *columns)))
    return numbered.groupBy(claim).agg(rows.alias("evidence_list"), F.count("*").alias("n_evidence"))
