"""The core operators as queries over the test tables, each with the same result in SQL where SQL can say it.

Corpus: `documents` (or `demo_corpus`); claims: `benchmark`; near-duplicate
candidates: `dedup_candidate`.  All tables are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import python_text, tokens
from ..functions.jcs import canonical_column
from ..functions.urls import TRACKING, canonical_url, registrable_domain
from ..operators import contract, detectors, fusion, grouping, planner, provenance, ranking, retrieval, store
from ..operators.instants import record_instants
from ..session import spread, table, written

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2025-06-01T00:00:00Z"
SALT = "claimloom-text-detector|"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The columns of `documents`, over all cores: texts are dear to cut into tokens."""
    return spread(table(spark, d, "documents").select(*columns))


# --- pieces of SQL -----------------------------------------------------------

_quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_RAW = lambda c: rf"regexp_extract_all(coalesce({c}, ''), '[\p{{L}}\p{{N}}_]+')"
_SEARCH = lambda c: f"list_transform({_RAW(c)}, lambda x: lower(x))"
_MATCH = lambda c: f"list_transform({_RAW(c)}, lambda x: replace(lower(x), 'ß', 'ss'))"
_CONTENT = lambda c: f"list_filter({_MATCH(c)}, lambda x: NOT list_contains({_quoted(tokens.MATCH_STOPS)}, x))"
_SHINGLES = lambda t, n: f"CASE WHEN len({t}) >= {n} THEN list_transform(range(0, len({t}) - {n - 1}), lambda i: array_to_string(list_slice({t}, i + 1, i + {n}), ' ')) WHEN len({t}) > 0 THEN [array_to_string({t}, ' ')] ELSE [] END"
# DuckDB has no NFKC: composed letters, full-width signs, ligatures and some spaces and dots are what the test tables need of it.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u00a0\u2009"
_PLAIN = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + "  "
FOLD_SQL = lambda c: f"lower(nfc_normalize(replace(replace(replace(replace(translate({c}, '{_WIDE}', '{_PLAIN}'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ß', 'ss'), '…', '...')))"
_SPACE = r"[\s\x0B\x{001C}-\x{001F}\x{0085}\p{Z}]"
_BLANK = lambda c: f"coalesce({c}, '') = ''"
_SIMHASH_SQL = lambda source: (
    f"SELECT key, {', '.join('CAST(' + ' + '.join(f'CASE WHEN sum(((({n} >> {i}) & 1) * 2 - 1)) > 0 THEN {1 << i} ELSE 0 END' for i in range(32)) + f' AS BIGINT) AS {n}' for n in ('hi', 'lo'))} FROM "
    f"(SELECT key, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS lo FROM (SELECT key, sha256(s) AS h FROM (SELECT key, unnest(grams) AS s FROM {source}))) GROUP BY key"
)


# --- B: projections and text functions ---------------------------------------


@query(f"SELECT doc_id, len({_SEARCH('text')}) AS n_search, len({_MATCH('text')}) AS n_match, len({_CONTENT('text')}) AS n_content, len(list_distinct({_CONTENT('text')})) AS n_distinct FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    n = tokens.token_count(F.col("text"))
    c = _documents(spark, d, "doc_id", "text").select("doc_id", n.alias("n_search"), n.alias("n_match"), F.inline(F.array(F.struct(tokens.content_tokens(F.col("text")).alias("c")))))
    return c.select("doc_id", "n_search", "n_match", F.size("c").alias("n_content"), F.size(F.array_distinct("c")).alias("n_distinct"))


@query("SELECT doc_id, sha256(text) AS text_sha256, length(text) AS n FROM documents")
def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.char_length("text").alias("n"))


@query(f"SELECT rec_id, sha256(trim(regexp_replace({FOLD_SQL('text')}, '{_SPACE}+', ' ', 'g'))) AS normalized_sha256 FROM demo_corpus")
def text_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "demo_corpus").select("rec_id", python_text.normalized_text_hash(F.col("text")).alias("normalized_sha256"))


@query(f"SELECT doc_id, len(g) AS n_shingles, len(list_distinct(g)) AS n_distinct, md5(array_to_string(g, '|')) AS digest FROM (SELECT doc_id, {_SHINGLES('t', 4)} AS g FROM (SELECT doc_id, {_CONTENT('text')} AS t FROM documents))")
def shingle_stats(spark: SparkSession, d: str) -> DataFrame:
    g = _documents(spark, d, "doc_id", "text").select("doc_id", tokens.content_tokens(F.col("text")).alias("t")).select("doc_id", tokens.shingles(F.col("t"), 4).alias("g"))
    return g.select("doc_id", F.size("g").alias("n_shingles"), F.size(F.array_distinct("g")).alias("n_distinct"), F.md5(F.array_join("g", "|")).alias("digest"))


@query(f"WITH s AS (SELECT doc_id AS key, {_SHINGLES('t', 4)} AS grams FROM (SELECT doc_id, {_CONTENT('text')} AS t FROM documents)), h AS ({_SIMHASH_SQL('s')}) SELECT s.key AS doc_id, coalesce(hi, 0) AS hi, coalesce(lo, 0) AS lo FROM s LEFT JOIN h USING (key)")
def simhash_sha256(spark: SparkSession, d: str) -> DataFrame:
    g = _documents(spark, d, "doc_id", "text").select("doc_id", tokens.shingles(tokens.content_tokens(F.col("text")), 4).alias("grams"))
    return tokens.simhash(g, "doc_id", "grams")


@query()
def simhash_blake2(spark: SparkSession, d: str) -> DataFrame:
    g = _documents(spark, d, "doc_id", "text").select("doc_id", tokens.shingles(tokens.content_tokens(F.col("text")), 4).alias("grams"))
    h = tokens.simhash(g, "doc_id", "grams", tokens.blake2_64)
    return h.select("doc_id", F.shiftleft("hi", 32).bitwiseOR(F.col("lo")).alias("simhash"))


_NETLOC = r"regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_HOSTPORT = f"regexp_replace({_NETLOC}, '^.*@', '')"
_DECODED = lambda x: f"url_decode(replace({x}, '+', ' '))"
_ENCODED = lambda x: f"replace(url_encode({x}), '%20', '+')"
#: The comparable form of the column `url`, by the rules of `urls.canonical`.
CANONICAL_SQL = lambda url: rf"""(SELECT CASE WHEN scheme IN ('http', 'https') AND netloc <> '' AND (port = '' OR (regexp_matches(port, '^[0-9]+$') AND CAST(port AS BIGINT) <= 65535)) THEN scheme || '://' || host
 || CASE WHEN port = '' OR CAST(port AS BIGINT) = 0 OR CAST(port AS BIGINT) = CASE scheme WHEN 'http' THEN 80 ELSE 443 END THEN '' ELSE ':' || CAST(CAST(port AS BIGINT) AS VARCHAR) END || CASE WHEN path = '' THEN '/' ELSE path END
 || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_transform(list_sort(kept), lambda z: {_ENCODED('z.k')} || '=' || {_ENCODED('z.v')}), '&') ELSE '' END END
 FROM (SELECT *, list_filter(list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: {{'k': {_DECODED("regexp_extract(x, '^[^=]*')")}, 'v': {_DECODED("regexp_extract(x, '=(.*)$', 1)")}}}), lambda z: NOT list_contains({_quoted(sorted(TRACKING))}, lower(z.k))) AS kept
 FROM (SELECT lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, {_NETLOC} AS netloc, regexp_replace(lower(regexp_extract({_HOSTPORT}, '^[^:]*')), '^www\.', '') AS host, regexp_extract({_HOSTPORT}, ':(.*)$', 1) AS port,
 rtrim(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS q FROM (SELECT trim({url}) AS u))))"""  # noqa: E731


@query(f"SELECT rec_id, {CANONICAL_SQL('url')} AS canonical FROM demo_corpus")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "demo_corpus").select("rec_id", canonical_url(F.col("url")).alias("canonical"))


_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', ''), '^www\.', '')"


@query(
    f"""SELECT rec_id, CASE WHEN coalesce(h, '') = '' THEN NULL WHEN len(p) <= 2 THEN h
    WHEN list_contains({_quoted(sorted(['co.id', 'or.id', 'web.id', 'go.id', 'ac.id', 'sch.id', 'my.id', 'biz.id', 'co.uk', 'org.uk', 'ac.uk', 'com.au', 'com.br', 'com.sg', 'com.my']))}, p[-2] || '.' || p[-1])
    THEN p[-3] || '.' || p[-2] || '.' || p[-1] ELSE p[-2] || '.' || p[-1] END AS domain
    FROM (SELECT rec_id, h, string_split(h, '.') AS p FROM (SELECT rec_id, {_HOST} AS h FROM demo_corpus))"""
)
def registrable_domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "demo_corpus").select("rec_id", registrable_domain(F.col("url")).alias("domain"))


@query(
    f"""SELECT run_id, key, CASE WHEN coalesce(length(text), 0) <= 320 OR len(wanted) = 0 THEN substr(coalesce(text, ''), 1, 320) ELSE substr(text, starts[list_position(counts, list_max(counts))] + 1, 320) END AS excerpt FROM
    (SELECT *, list_transform(starts, lambda a: len(list_filter({_MATCH("substr(text, CAST(a AS BIGINT) + 1, 320)")}, lambda x: list_contains(wanted, x)))) AS counts FROM
    (SELECT *, list_concat([0], list_transform(range(1, len(n) + 1), lambda i: CAST(list_sum(list_slice(n, 1, i)) AS BIGINT))) AS starts FROM
    (SELECT run_id, key, text, list_distinct({_CONTENT('title')}) AS wanted, list_transform(regexp_extract_all(coalesce(text, ''), '(?s).*?[.!?]{_SPACE}+'), lambda x: length(x)) AS n FROM candidate)))"""
)
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "candidate").select("run_id", "key", "text", F.array_distinct(tokens.content_tokens(F.col("title"))).alias("wanted"))
    return t.select("run_id", "key", python_text.excerpts(F.col("text"), F.col("wanted")).alias("excerpt"))


# --- C, D, E, H: planning, search, fusion, ranking ---------------------------

_PLAN = rf"""plan AS (SELECT item_id, trim(text) AS cap, list_slice(list_transform(list_filter(list_zip(k, range(1, len(k) + 1)), lambda z: list_position(k, z[1]) = z[2]), lambda z: z[1]), 1, 8) AS kw FROM
 (SELECT item_id, text, list_filter({_RAW('text')}, lambda x: length(x) >= 3 AND NOT list_contains({_quoted(tokens.PLAN_STOPS)}, lower(x))) AS k FROM benchmark)),
 queries AS (SELECT item_id, 'q' || lpad(CAST(s AS VARCHAR), 3, '0') AS query_id, q AS query, v AS variation, s AS query_seq FROM (
 SELECT item_id, 1 AS s, 'caption' AS v, cap AS q FROM plan UNION ALL SELECT item_id, 2, 'entity', array_to_string(kw, ' ') FROM plan
 UNION ALL SELECT item_id, 3, 'fact_check', array_to_string(list_slice(kw, 1, 5), ' ') || ' {planner.FACT_CHECK_SUFFIX}' FROM plan))"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return planner.plan_queries(table(spark, d, "benchmark"), "item_id", "text")


@query(f"WITH {_PLAN} SELECT item_id, query_id, query, variation FROM queries")
def planned_queries(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("item_id", "query_id", "query", "variation")


_TF = f"""tok AS (SELECT doc_id, {_SEARCH('text')} AS toks FROM documents), dl AS (SELECT doc_id, len(toks) AS dl FROM tok),
 st AS (SELECT count(*) AS n_docs, CASE WHEN sum(dl) > 0 THEN sum(dl) / CAST(count(*) AS DOUBLE) ELSE 1.0 END AS avgdl FROM dl),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
_GAIN = """gain AS (SELECT tf.doc_id, tf.term, ln(1 + (n_docs - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.5e0) / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)) AS g FROM tf JOIN df USING (term) JOIN dl USING (doc_id), st)"""


@query(f"WITH {_TF} SELECT term, df, round(ln(1 + (n_docs - df + 0.5e0) / (df + 0.5e0)), 6) AS idf FROM df, st")
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.document_frequencies(_documents(spark, d, "doc_id", "text"), "doc_id", "text")


@query(
    f"""WITH {_TF}, {_GAIN}, q AS (SELECT DISTINCT item_id, unnest({_SEARCH('text')}) AS term FROM benchmark),
    s AS (SELECT item_id, doc_id, round(sum(g), 6) AS score FROM q JOIN gain USING (term) GROUP BY ALL)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10 AND score > 0"""
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.search(table(spark, d, "benchmark"), _documents(spark, d, "doc_id", "text"), ["item_id"], "text", "doc_id", "text")
    return hits.select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


_HITS = f"""{_PLAN}, {_TF}, {_GAIN}, qt AS (SELECT DISTINCT item_id, query_id, variation, unnest({_SEARCH('query')}) AS term FROM queries),
 s AS (SELECT item_id, query_id, variation, doc_id, round(sum(g), 6) AS score FROM qt JOIN gain USING (term) GROUP BY ALL),
 hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10 AND score > 0)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    q = written(_queries(spark, d), "queries")
    return retrieval.search(q, _documents(spark, d, "doc_id", "text"), ["item_id", "query_id", "variation", "query_seq"], "query", "doc_id", "text")


@query(f"WITH {_HITS} SELECT queries.item_id, query_id || ':local_corpus' AS query_log_id, query, count(doc_id) AS result_count FROM queries LEFT JOIN hits USING (item_id, query_id) GROUP BY ALL")
def query_log(spark: SparkSession, d: str) -> DataFrame:
    n = _hits(spark, d).groupBy("item_id", "query_id").agg(F.count("*").alias("n"))
    log = _queries(spark, d).join(n, ["item_id", "query_id"], "left")
    return log.select("item_id", F.concat("query_id", F.lit(":local_corpus")).alias("query_log_id"), "query", F.coalesce("n", F.lit(0)).alias("result_count"))


@query(f"WITH {_HITS} SELECT item_id, doc_id, min_by('local_corpus:' || variation, query_id) AS discovery_method, min_by(rank, query_id) AS provider_rank, count(*) AS n_hits FROM hits GROUP BY ALL")
def merged_candidates(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).withColumn("discovery_method", F.concat(F.lit("local_corpus:"), "variation")).withColumn("provider_rank", F.col("rank").cast("long"))
    return fusion.merge_hits(hits.withColumnRenamed("doc", "doc_id"), "item_id", "doc_id", ["query_seq", "rank"], ["discovery_method", "provider_rank"])


@query(f"WITH {_HITS} SELECT item_id, doc_id, round(sum(1 / (60e0 + rank)), 6) AS fusion_score FROM hits GROUP BY ALL")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(_hits(spark, d).withColumnRenamed("doc", "doc_id"), "item_id", "doc_id", "rank")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    fused = rrf_fusion(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "lang", "author")
    claims = table(spark, d, "benchmark").select("item_id", F.col("text").alias("claim"))
    df = fused.join(docs, "doc_id").join(claims, "item_id").withColumn("title", F.coalesce("author", F.lit("")))
    df = df.withColumn("content_status", F.lit("full")).withColumn("credibility", F.lit(None).cast("double")).withColumn("temporal_eligible", F.lit(None).cast("boolean"))
    return ranking.rerank(ranking.feature_columns(df, "item_id", "claim"))


_FEATURES = f"""fused AS (SELECT item_id, doc_id, round(sum(1 / (60e0 + rank)), 6) AS fusion_score FROM hits GROUP BY ALL),
 x AS (SELECT f.*, d.source, list_distinct({_CONTENT('b.text')}) AS q, list_distinct({_MATCH("coalesce(d.author, '')")}) AS t, {_CONTENT('d.text')} AS body, {_CONTENT('b.text')} AS qq FROM fused f JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
 y AS (SELECT *, list_distinct({_SHINGLES('qq', 2)}) AS g1, list_distinct({_SHINGLES('body', 2)}) AS g2, max(fusion_score) OVER (PARTITION BY item_id) AS top FROM x),
 z AS (SELECT item_id, doc_id, source, fusion_score,
  CASE WHEN len(q) > 0 THEN len(list_intersect(q, list_distinct(list_concat(body, t)))) / CAST(len(q) AS DOUBLE) ELSE 0.0 END AS query_coverage,
  CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / CAST(len(q) AS DOUBLE) ELSE 0.0 END AS title_match,
  CASE WHEN len(list_distinct(list_concat(g1, g2))) > 0 THEN len(list_intersect(g1, g2)) / CAST(len(list_distinct(list_concat(g1, g2))) AS DOUBLE) ELSE 0.0 END AS body_overlap,
  CASE WHEN top > 0 THEN fusion_score / top ELSE 0.0 END AS fusion_prior FROM y),
 sc AS (SELECT *, round(2.4e0 * query_coverage, 6) + round(0.9e0 * title_match, 6) + round(1.2e0 * body_overlap, 6) + round(1.1e0 * fusion_prior, 6) + 0.8e0 + 0.3e0 - 0.3e0 - 1.5e0 AS s FROM z)"""


@query(f"WITH {_HITS}, {_FEATURES} SELECT item_id, doc_id, round(query_coverage, 6) AS query_coverage, round(title_match, 6) AS title_match, round(body_overlap, 6) AS body_overlap, round(fusion_prior, 6) AS fusion_prior FROM z")
def rerank_features(spark: SparkSession, d: str) -> DataFrame:
    names = ["query_coverage", "title_match", "body_overlap", "fusion_prior"]
    return _ranked(spark, d).select("item_id", "doc_id", *[F.round(f"f_{n}", 6).alias(n) for n in names])


@query(f"WITH {_HITS}, {_FEATURES} SELECT item_id, doc_id, round(s, 6) AS rerank_score, round(1 / (1 + exp(-s)), 6) AS relevance_score FROM sc")
def rerank_scores(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("item_id", "doc_id", "rerank_score", "relevance_score")


_PARTS = {"query_coverage": 2.4, "title_match": 0.9, "body_overlap": 1.2, "fusion_prior": 1.1, "content_completeness": 0.8, "credibility": 0.6, "image_match": 0.7, "temporal_eligible": 0.5, "temporal_ineligible_penalty": -1.4, "unknown_date_penalty": -0.3, "bias": -1.5}
_KNOWN = {"content_completeness": "1e0", "credibility": "0.5e0", "image_match": "0e0", "temporal_eligible": "0e0", "temporal_ineligible_penalty": "0e0", "unknown_date_penalty": "1e0", "bias": "1e0"}
_VALUES = ", ".join(f"{{'part': 'feature.{k}', 'value': round({_KNOWN.get(k, k)}, 6)}}, {{'part': 'contribution.{k}', 'value': round({w}e0 * {_KNOWN.get(k, k)}, 6) + 0e0}}" for k, w in _PARTS.items())


@query(
    f"""WITH {_HITS}, {_FEATURES}, v AS (SELECT item_id, doc_id, [{_VALUES}, {{'part': 'fusion_rrf', 'value': round(fusion_score, 6)}}] AS l FROM z),
    st3 AS (SELECT item_id, doc_id, l, array_to_string(list_transform(list_slice(list_sort(list_transform(list_filter(l, lambda e: e.part LIKE 'contribution.%' AND e.part <> 'contribution.bias' AND abs(e.value) > 1e-9), lambda e: {{'a': -abs(e.value), 'n': substr(e.part, 14)}})), 1, 3), lambda e: e.n), ',') AS strongest FROM v)
    SELECT item_id, doc_id, e.part AS part, e.value AS value, strongest FROM (SELECT item_id, doc_id, unnest(l) AS e, strongest FROM st3)"""
)
def score_breakdown(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(spark, d)
    return r.select("item_id", "doc_id", F.explode("score_breakdown").alias("part", "value"), F.array_join(ranking.strongest(F.col("score_breakdown")), ",").alias("strongest"))


@query()
def mmr_top(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(spark, d).withColumn("body", F.concat_ws(" ", "title", F.coalesce("text", F.lit("")))).withColumn("ord", F.row_number().over(ranking.Window.partitionBy("item_id").orderBy(F.desc("rerank_score"), "doc_id")))
    return ranking.diversify(r, "item_id", "doc_id", "source", "ord", "body")


@query(f"WITH {_HITS}, {_FEATURES} SELECT item_id, count(*) AS items, count(DISTINCT coalesce(source, '')) AS independent_groups, CAST(1 AS BIGINT) AS providers, round(count(DISTINCT coalesce(source, '')) / CAST(count(*) AS DOUBLE), 6) AS group_ratio FROM z GROUP BY item_id")
def source_diversity(spark: SparkSession, d: str) -> DataFrame:
    r = _hits(spark, d).select("item_id", F.col("doc").alias("doc_id")).distinct().join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumn("provider", F.lit("local_corpus"))
    return ranking.source_diversity(r, ["item_id"], "source", "provider")


@query(
    """WITH l AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT * FROM l WHERE vec_id % 50 = 0),
    p AS (SELECT q.vec_id AS query, l.vec_id, round(list_dot_product(q.v, l.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(l.v, l.v))), 6) AS similarity FROM q, l WHERE q.vec_id <> l.vec_id)
    SELECT query, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM p) WHERE rank <= 10"""
)
def dense_neighbours(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return ranking.dense_neighbours(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding")


@query(
    f"""WITH {_TF}, {_GAIN}, q AS (SELECT DISTINCT item_id, unnest({_SEARCH('text')}) AS term FROM benchmark), s AS (SELECT item_id, doc_id, round(sum(g), 6) AS score FROM q JOIN gain USING (term) GROUP BY ALL),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10 AND score > 0),
    gi AS (SELECT DISTINCT item_id, unnest({_SHINGLES('t', 8)}) AS g FROM (SELECT item_id, {_SEARCH('text')} AS t FROM benchmark)), gd AS (SELECT doc_id, unnest({_SHINGLES('toks', 8)}) AS g FROM tok), rel AS (SELECT DISTINCT item_id, doc_id FROM gd JOIN gi USING (g)),
    h AS (SELECT item_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM top JOIN rel USING (item_id, doc_id) GROUP BY item_id), n AS (SELECT item_id, count(*) AS n FROM rel GROUP BY item_id)
    SELECT item_id, round(coalesce(hits, 0) / 10e0, 6) AS precision, round(coalesce(hits, 0) / CAST(n AS DOUBLE), 6) AS recall, round(coalesce(1e0 / first, 0), 6) AS mrr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, CAST(least(n, 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM n LEFT JOIN h USING (item_id)"""
)
def search_quality(spark: SparkSession, d: str) -> DataFrame:
    """BM25 judged by exact containment: a document is relevant if it holds a run of eight words of the item."""
    item = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(tokens.shingles(tokens.search_tokens(F.col("text")), 8))).alias("g"))
    doc = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(tokens.shingles(tokens.search_tokens(F.col("text")), 8))).alias("g"))
    relevant = doc.join(item, "g").select("item_id", "doc_id").distinct()
    return ranking.judged_metrics(bm25_topk(spark, d), relevant, "item_id", "doc_id")


# --- F: grouping -------------------------------------------------------------

_NEAR = f"""f AS (SELECT key, {_CONTENT("coalesce(title, '') || ' ' || coalesce(text, '')")} AS t FROM dedup_candidate), s AS (SELECT key, {_SHINGLES('t', 4)} AS grams FROM f WHERE len(t) >= 12),
 g AS (SELECT DISTINCT key, unnest(grams) AS g FROM s), n AS (SELECT key, count(*) AS n FROM g GROUP BY key),
 o AS (SELECT x.key AS a, y.key AS b, count(*) AS overlap FROM g x JOIN g y ON x.g = y.g AND x.key < y.key GROUP BY ALL),
 near AS (SELECT a, b, overlap, p.n + q.n AS size_sum FROM o JOIN n p ON p.key = a JOIN n q ON q.key = b WHERE overlap * 100 >= (p.n + q.n - overlap) * 70)"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    return grouping.features(spread(table(spark, d, "dedup_candidate")))


@query(f"WITH {_NEAR} SELECT a, b, overlap, size_sum FROM near")
def near_dup_pairs_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return grouping.near_duplicate_pairs(_features(spark, d), hamming_max=None)


@query(f"WITH {_NEAR}, h AS ({_SIMHASH_SQL('s')}) SELECT a, b, overlap, size_sum FROM near JOIN h p ON p.key = a JOIN h q ON q.key = b WHERE bit_count(xor(p.hi, q.hi)) + bit_count(xor(p.lo, q.lo)) <= 12")
def near_dup_pairs_gated(spark: SparkSession, d: str) -> DataFrame:
    return grouping.near_duplicate_pairs(_features(spark, d), digest=tokens.sha256_64)


@query(
    f"""WITH RECURSIVE {_NEAR}, e AS (SELECT a, b FROM near UNION SELECT b, a FROM near), r(key, m) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.key),
    c AS (SELECT key, min(m) AS root FROM r GROUP BY key), k AS (SELECT DISTINCT d.key, coalesce(root, d.key) AS root FROM dedup_candidate d LEFT JOIN c ON c.key = d.key),
    i AS (SELECT root, 'dc_' || substr(sha256(string_agg(key, chr(31) ORDER BY key)), 1, 24) AS duplicate_cluster_id FROM k GROUP BY root) SELECT key, root, duplicate_cluster_id FROM k JOIN i USING (root)"""
)
def near_dup_components(spark: SparkSession, d: str) -> DataFrame:
    feats = _features(spark, d)
    parts = grouping.connected_components(feats, grouping.near_duplicate_pairs(feats, hamming_max=None))
    return grouping.stable_ids(parts, "dc").select("key", "root", F.col("group_id").alias("duplicate_cluster_id"))


@query()
def independence_groups(spark: SparkSession, d: str) -> DataFrame:
    return grouping.assign_groups(spread(table(spark, d, "dedup_candidate")))


@query()
def dedup_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    return grouping.dedup_effectiveness(grouping.assign_groups(spread(table(spark, d, "dedup_candidate")), siblings=False))


@query(
    """SELECT count(DISTINCT key) AS items, count(DISTINCT duplicate_cluster_id) AS duplicate_clusters, count(DISTINCT independence_group_id) AS independence_groups,
    round(1 - count(DISTINCT duplicate_cluster_id) / CAST(count(DISTINCT key) AS DOUBLE), 6) AS duplicate_reduction_ratio, round(1 - count(DISTINCT independence_group_id) / CAST(count(DISTINCT key) AS DOUBLE), 6) AS independence_reduction_ratio FROM group_assignment"""
)
def assignment_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    return grouping.dedup_effectiveness(table(spark, d, "group_assignment"))


# --- G: provenance -----------------------------------------------------------

_ISO = r"""CASE WHEN regexp_matches(upper(T), '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})$')
 THEN epoch_us(try_cast(substr(upper(T), 1, 10) || ' ' || rpad(regexp_extract(upper(T), '^.{11}([0-9]{2}:[0-9]{2}(?::[0-9]{2})?)', 1), 8, ':00') || coalesce('.' || nullif(regexp_extract(T, '[.,]([0-9]{1,6})', 1), ''), '') AS TIMESTAMP))
 - CASE WHEN regexp_matches(upper(T), 'Z$') THEN 0 ELSE (CAST(regexp_extract(T, '([+-])([0-9]{2}):?([0-9]{2})$', 2) AS BIGINT) * 60 + CAST(regexp_extract(T, '([+-])([0-9]{2}):?([0-9]{2})$', 3) AS BIGINT)) * 60000000 * CASE WHEN regexp_extract(T, '([+-])([0-9]{2}):?([0-9]{2})$', 1) = '-' THEN -1 ELSE 1 END END END""".replace("(T", r"(regexp_replace(published_at, '^\s+|\s+$', '', 'g')")


@query(f"SELECT rec_id, us AS published_us, CASE WHEN us IS NULL THEN NULL ELSE us <= epoch_us(TIMESTAMP '2025-06-01 00:00:00') END AS temporal_eligible, CASE WHEN us IS NOT NULL THEN 'source.published_at' END AS date_basis FROM (SELECT rec_id, {_ISO} AS us FROM demo_corpus)")
def temporal_eligibility(spark: SparkSession, d: str) -> DataFrame:
    df = provenance.temporal(table(spark, d, "demo_corpus"), "published_at", provenance.parse_timestamp(F.lit(AS_OF)))
    return df.select("rec_id", F.unix_micros(provenance.parse_timestamp(F.col("published_at"))).alias("published_us"), "temporal_eligible", "date_basis")


@query(
    f"""SELECT rec_id, round(greatest(0.0e0, least(1.0e0, (CASE kind WHEN 'fact_check' THEN 0.8e0 WHEN 'official' THEN 0.75e0 WHEN 'news' THEN 0.55e0 WHEN 'local_corpus' THEN 0.5e0 WHEN 'web' THEN 0.35e0 WHEN 'image_provenance' THEN 0.4e0 ELSE 0.3e0 END
    + CASE WHEN {_BLANK('url')} THEN 0.0e0 ELSE 0.1e0 END + CASE WHEN {_BLANK('publisher')} THEN 0.0e0 ELSE 0.1e0 END + CASE WHEN {_ISO} IS NULL THEN 0.0e0 ELSE 0.1e0 END + CASE WHEN {_BLANK('text')} THEN 0.0e0 ELSE 0.2e0 END) / 1.3e0)), 6) AS credibility FROM demo_corpus"""
)
def credibility(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "demo_corpus").withColumn("status", F.when(F.coalesce("text", F.lit("")) == "", "unavailable").otherwise("full"))
    return provenance.credibility(df, "kind", "url", "publisher", "published_at", "status").select("rec_id", "credibility")


# --- J: detectors ------------------------------------------------------------

_TRIM = r"regexp_replace(coalesce(text, ''), '^[\s\x0B\x{0085}\p{Z}]+|[\s\x0B\x{0085}\p{Z}]+$', '', 'g')"


@query(
    f"""SELECT doc_id, CASE WHEN e IS NULL THEN 'ok' ELSE 'unsupported' END AS status, e AS error_code, CASE WHEN e IS NULL THEN s END AS ai_score,
    CASE WHEN e IS NOT NULL THEN 'not_assessed' WHEN s >= 0.75e0 THEN 'likely_ai_generated' WHEN s <= 0.25e0 THEN 'likely_human_or_camera' ELSE 'uncertain' END AS assessment
    FROM (SELECT doc_id, CASE WHEN length(t) < 120 THEN 'TEXT_TOO_SHORT' WHEN coalesce(lower(regexp_extract(lang, '^[^-_]*')), '') <> 'en' THEN 'LANGUAGE_NOT_SUPPORTED' END AS e,
    round(CAST('0x' || substr(sha256('{SALT}' || t), 1, 8) AS BIGINT) / 4294967295.0e0, 6) AS s FROM (SELECT doc_id, lang, {_TRIM} AS t FROM documents))"""
)
def detector_signals(spark: SparkSession, d: str) -> DataFrame:
    df = detectors.fixture_text_signals(table(spark, d, "documents"), "text", F.col("lang"), SALT)
    return df.select("doc_id", "status", "error_code", "ai_score", "assessment")


@query(
    """SELECT run_id, key, ranked_at, CASE WHEN isnan(relevance_score) THEN NULL ELSE relevance_score END AS relevance_score, n AS normalized, CASE WHEN n IS NULL THEN 'uncertain' WHEN n >= 0.75e0 THEN 'likely_ai_generated' WHEN n <= 0.25e0 THEN 'likely_human_or_camera' ELSE 'uncertain' END AS assessment
    FROM (SELECT run_id, key, ranked_at, relevance_score, CASE WHEN relevance_score IS NOT NULL AND NOT isnan(relevance_score) AND relevance_score BETWEEN 0 AND 0.9 THEN round(1 - relevance_score / 0.9e0, 6) END AS n FROM ranked_item)"""
)
def score_normalisation(spark: SparkSession, d: str) -> DataFrame:
    n = F.round(detectors.normalize_score(F.col("relevance_score"), F.lit(0.0), F.lit(0.9), F.lit(False)), 6)
    df = table(spark, d, "ranked_item").withColumn("normalized", n).withColumn("relevance_score", F.nanvl("relevance_score", F.lit(None).cast("double")))
    return df.select("run_id", "key", "ranked_at", "relevance_score", "normalized", detectors.assessment(F.lit("ok"), F.col("normalized")).alias("assessment"))


@query("SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS score, CASE WHEN NOT json_valid(props) THEN 'RESPONSE_MALFORMED' WHEN coalesce(json_type(props, '$.k'), 'NULL') = 'NULL' THEN 'SCORE_MISSING' WHEN json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'SCORE_NOT_A_NUMBER' END AS error_code FROM events")
def detector_answers(spark: SparkSession, d: str) -> DataFrame:
    """Scores read out of event payloads, as a detector's answers would be."""
    e = table(spark, d, "events")
    score, code = detectors.response_score(F.col("props"), "k")
    return e.select("event_id", score.alias("score"), code.alias("error_code"))


# --- K: store ----------------------------------------------------------------


@query(f"SELECT kind, count(*) AS n_docs, count(*) FILTER (WHERE {_BLANK('published_at')}) AS undated, count(*) FILTER (WHERE {_BLANK('url')}) AS without_url FROM demo_corpus GROUP BY kind")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.corpus_stats(table(spark, d, "demo_corpus"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(event_id, (ts, event_id)) AS event_id, count(*) AS n_events FROM events GROUP BY user_id")
def job_last_state(spark: SparkSession, d: str) -> DataFrame:
    return store.last_state(table(spark, d, "events"), "user_id", "ts", "event_id", ["event_type", "event_id"])


@query("SELECT event_id, first_id, CASE WHEN first_id = event_id THEN 'new' WHEN h IS NOT DISTINCT FROM event_type THEN 'same' ELSE 'conflict' END AS replay FROM (SELECT event_id, event_type, first_value(event_id) OVER w AS first_id, first_value(event_type) OVER w AS h FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def idempotency(spark: SparkSession, d: str) -> DataFrame:
    return store.idempotent(table(spark, d, "events"), ["user_id"], "event_type", "ts", "event_id").select("event_id", "first_id", "replay")


@query("SELECT event_id, user_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS INTEGER) AS place FROM events ORDER BY ts, event_id LIMIT 20")
def fifo_claim(spark: SparkSession, d: str) -> DataFrame:
    return store.claim_order(table(spark, d, "events"), "ts", "event_id", 20).select("event_id", "user_id", "place")


@query("SELECT event_id, CASE WHEN event_type = 'purchase' AND ts < TIMESTAMP '2024-01-02' THEN CASE WHEN user_id % 5 >= 3 THEN 'failed' ELSE 'queued' END WHEN event_type = 'purchase' THEN 'running' ELSE event_type END AS status FROM events")
def lease_recovery(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "purchase", "running").otherwise(F.col("event_type")).alias("status"), F.col("ts").alias("lease_expires_at"), (F.col("user_id") % 5).alias("attempts"))
    return store.recover_leases(jobs, F.lit("2024-01-02").cast("timestamp_ntz")).select("event_id", "status")


@query(
    """SELECT case_id, CAST(claim_revision AS INTEGER) AS claim_revision, min(coalesce(mode, '')) AS text_hash, CASE WHEN min(coalesce(mode, '')) <> max(coalesce(mode, '')) THEN 'conflict' WHEN claim_revision > 1 THEN 'insert' WHEN min(coalesce(mode, '')) = 'live' THEN 'keep' ELSE 'conflict' END AS action FROM retrieval_runs GROUP BY case_id, claim_revision"""
)
def upsert_revisions(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "retrieval_runs").select("case_id", "claim_revision", F.coalesce("mode", F.lit("")).alias("text_hash"))
    existing = runs.where("claim_revision = 1").select("case_id", "claim_revision").distinct().withColumn("text_hash", F.lit("live"))
    return store.upsert_revisions(existing, runs)


@query()
def evidence_lists(spark: SparkSession, d: str) -> DataFrame:
    top = mmr_top(spark, d).where("place <= 20")
    e = store.assemble_evidence(top, "item_id", "place", ["doc_id"])
    return e.select("item_id", "n_evidence", F.to_json("evidence_list").alias("evidence_json"))


_JSON = lambda c: f"CASE WHEN {c} IS NULL THEN 'null' ELSE '\"' || {c} || '\"' END"
_RUN = f"""'{{"case_id":' || {_JSON('case_id')} || ',"claim_revision":' || coalesce(CAST(claim_revision AS VARCHAR), 'null') || ',"mode":' || {_JSON('mode')} || ',"run_id":' || {_JSON('run_id')} || ',"status":' || {_JSON('status')} || '}}'"""


@query(f"SELECT run_id, j AS canonical, 'run_' || sha256(j) AS content_id FROM (SELECT run_id, {_RUN} AS j FROM retrieval_runs)")
def canonical_records(spark: SparkSession, d: str) -> DataFrame:
    """Canonical JSON of each run and the id derived from it."""
    j = canonical_column(F.to_json(F.struct("run_id", "case_id", "claim_revision", "mode", "status"), {"ignoreNullFields": "false"}))
    return table(spark, d, "retrieval_runs").select("run_id", j.alias("canonical")).withColumn("content_id", F.concat(F.lit("run_"), F.sha2("canonical", 256)))


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The UTC instant of every dated record of `demo_corpus`."""
    return record_instants(table(spark, d, "demo_corpus"), table(spark, d, "publishers"), table(spark, d, "dedup_candidate"))


# --- I: contract -------------------------------------------------------------


@query("SELECT ranked_item.run_id, key, ranked_at, CASE WHEN r.run_id IS NULL THEN 'RUN_REFERENCE_UNKNOWN' WHEN relevance_score IS NULL OR isnan(relevance_score) THEN 'NON_FINITE_NUMBER' WHEN relevance_score < 0 OR relevance_score > 1 THEN 'SCORE_OUT_OF_RANGE' WHEN kind NOT IN ('fact_check', 'news', 'official', 'web', 'image_provenance', 'local_corpus', 'user_supplied') THEN 'ENUM_INVALID' END AS code FROM ranked_item LEFT JOIN (SELECT DISTINCT run_id FROM retrieval_runs) r USING (run_id)")
def item_violations(spark: SparkSession, d: str) -> DataFrame:
    """The first broken rule of each ranked item, null for none; references by an outer join."""
    runs = table(spark, d, "retrieval_runs").select(F.col("run_id").alias("known")).distinct()
    s = F.col("relevance_score")
    code = F.when(F.col("known").isNull(), "RUN_REFERENCE_UNKNOWN").when(s.isNull() | F.isnan(s), "NON_FINITE_NUMBER").when(~s.between(0, 1), "SCORE_OUT_OF_RANGE").when(~F.col("kind").isin(contract.ENUMS["kind"].split()), "ENUM_INVALID")
    items = table(spark, d, "ranked_item")
    return items.join(runs, items["run_id"] == runs["known"], "left").select("run_id", "key", "ranked_at", code.alias("code"))
