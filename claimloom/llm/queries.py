"""Queries of the training-data operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.core import CANONICAL_SQL, FOLD_SQL
from ..session import table
from . import abuse, contributor_caps, exact_copies, language, leaks, near_copies, survivors, tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def _p1_rows(spark: SparkSession, d: str) -> DataFrame:
    return survivors.prepared(*(table(spark, d, t) for t in ("candidate", "group_assignment", "publishers", "dedup_candidate")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(_p1_rows(spark, d))


def p1_truth(spark: SparkSession, d: str) -> DataFrame:
    return survivors.truth_discovery(_p1_rows(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return language.label_report(table(spark, d, "demo_corpus")).where("not label_ok").select("rec_id", "seg_start", "lang")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return language.label_report(table(spark, d, "demo_corpus"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    items = contributor_caps.with_contributor(contributor_caps.latest_items(table(spark, d, "ranked_item")), table(spark, d, "dedup_candidate"))
    return contributor_caps.beyond_cap(items, ["run_id", "contributor"], "relevance_score", "key", max_count=2).select("run_id", "key")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return exact_copies.copy_rows(exact_copies.fingerprints(table(spark, d, "demo_corpus")))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return exact_copies.copy_counts(exact_copies.fingerprints(table(spark, d, "demo_corpus")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.near_copy_pairs(*near_copies.similar_classes(table(spark, d, "demo_corpus"), threshold=0.5, width=3))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leaks.without_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"), least=abuse.THRESHOLD).where(f"score >= {abuse.THRESHOLD}").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_truth, p3_found, p3_report, p4_found, p5_found, p5_counts, p6_found, p7_ids, p8_found, p8_cleaned, p9_found, p9_scores, p9_rates)}


_WORDS = lambda c: rf"regexp_extract_all({FOLD_SQL(c)}, '[\p{{L}}\p{{N}}]+')"
_NAME = lambda c: rf"regexp_replace({FOLD_SQL(c)}, '[^\p{{L}}\p{{N}}]+', '', 'g')"
_IS_BLANK = lambda c: rf"NOT regexp_matches(coalesce({c}, ''), '[^\s\x0B\x{{0085}}\p{{Z}}]')"

_P4 = rf"""WITH latest AS (SELECT run_id, key, max_by(struct_pack(g := independence_group_id, s := relevance_score), (ranked_at, CASE WHEN isnan(relevance_score) OR relevance_score IS NULL THEN CAST('-inf' AS DOUBLE) ELSE relevance_score END, independence_group_id)) AS r
 FROM ranked_item WHERE run_id IS NOT NULL AND key IS NOT NULL GROUP BY run_id, key),
 named AS (SELECT run_id, l.key, CASE WHEN NOT ({_IS_BLANK('r.g')}) THEN 'g:' || r.g WHEN NOT ({_IS_BLANK('publisher')}) THEN 'p:' || {_NAME('publisher')} ELSE 'i:' || l.key END AS who, CASE WHEN isnan(r.s) THEN NULL ELSE r.s END AS s
 FROM latest l LEFT JOIN dedup_candidate d ON d.key = l.key)
 SELECT run_id, key FROM (SELECT run_id, key, row_number() OVER (PARTITION BY run_id, who ORDER BY s DESC NULLS LAST, key) AS place FROM named) WHERE place > 2"""

_P5 = rf"""WITH f AS (SELECT rec_id, {_NAME('text')} AS t, CASE WHEN {_IS_BLANK('url')} THEN '' ELSE coalesce({CANONICAL_SQL('url')}, chr(2) || trim(url)) END AS u FROM demo_corpus WHERE NOT ({_IS_BLANK('text')})), g AS (SELECT t, u, min(rec_id) AS keep, count(*) AS n FROM f GROUP BY t, u)"""

_P6 = rf"""WITH w AS (SELECT rec_id, {_WORDS("coalesce(title, '') || ' ' || text")} AS ws FROM demo_corpus WHERE NOT ({_IS_BLANK('text')})),
 s AS (SELECT DISTINCT rec_id, hash(unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(0, len(ws) - 2), lambda i: ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) ELSE [array_to_string(ws, ' ')] END)) AS g FROM w),
 n AS (SELECT rec_id, count(*) AS n FROM s GROUP BY rec_id), o AS (SELECT a.rec_id AS a, b.rec_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rec_id < b.rec_id GROUP BY ALL)
 SELECT a AS rec_id_a, b AS rec_id_b FROM o JOIN n p ON p.rec_id = a JOIN n q ON q.rec_id = b WHERE c >= 0.5e0 * (p.n + q.n - c) - 1e-9"""

_P8 = rf"""WITH i AS (SELECT item_id, {_WORDS('text')} AS ws FROM benchmark), d AS (SELECT doc_id, {_WORDS('text')} AS ws FROM documents WHERE text IS NOT NULL),
 gi AS (SELECT DISTINCT item_id, hash(unnest(list_transform(range(0, greatest(len(ws) - 11, 0)), lambda k: array_to_string(list_slice(ws, k + 1, k + 12), ' ')))) AS g FROM i),
 gd AS (SELECT doc_id, hash(unnest(list_transform(range(0, greatest(len(ws) - 11, 0)), lambda k: array_to_string(list_slice(ws, k + 1, k + 12), ' ')))) AS g FROM d)
 SELECT DISTINCT doc_id, item_id FROM gd JOIN gi USING (g)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries SQL can say; the others are tested against brute force, round trips and rated rows."""
    return {
        "p4_found": _P4, "p6_found": _P6, "p8_found": _P8,
        "p5_found": f"{_P5} SELECT keep AS keep_rec_id, rec_id AS copy_rec_id FROM f JOIN g USING (t, u) WHERE rec_id <> keep",
        "p5_counts": f"{_P5} SELECT keep AS keep_rec_id, n AS n_copies FROM g",
    }
