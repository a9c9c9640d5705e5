"""BM25 retrieval of many queries over one corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import search_tokens, token_count
from ..session import written

K1, B = 1.5, 0.75
#: Bytes of query terms up to which they are broadcast to the postings.
BROADCAST_TERMS = 2_000_000


def term_frequencies(corpus: DataFrame, doc: str, text: str, terms: DataFrame | None = None, broadcast: bool = False) -> DataFrame:
    """`doc, term, tf, dl`; only for `terms` where given, so other tokens are never shuffled."""
    tokens = corpus.select(F.col(doc).alias("doc"), search_tokens(F.col(text)).alias("toks")).withColumn("dl", F.size("toks"))
    rows = tokens.select("doc", "dl", F.explode("toks").alias("term"))
    if terms is not None:
        rows = rows.join(F.broadcast(terms) if broadcast else terms, "term", "left_semi")
    return rows.groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(corpus: DataFrame, text: str) -> DataFrame:
    """One row: the number of documents and their mean length (1 where that is 0)."""
    n = token_count(F.col(text))
    mean = F.sum(n) / F.count("*")
    return corpus.agg(F.count("*").alias("n_docs"), F.when(mean > 0, mean).otherwise(F.lit(1.0)).alias("avgdl"))


def idf(n_docs: str, df: str) -> F.Column:
    return F.log(1 + (F.col(n_docs) - F.col(df) + 0.5) / (F.col(df) + 0.5))


def document_frequencies(corpus: DataFrame, doc: str, text: str) -> DataFrame:
    """`term, df, idf` over the whole corpus; distinct terms of a document before the shuffle."""
    terms = corpus.select(F.explode(F.array_distinct(search_tokens(F.col(text)))).alias("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("df"))
    return counts.crossJoin(F.broadcast(corpus_stats(corpus, text).select("n_docs"))).select("term", "df", F.round(idf("n_docs", "df"), 6).alias("idf"))


def search(queries: DataFrame, corpus: DataFrame, query: list[str], query_text: str, doc: str, text: str, limit: int = 10) -> DataFrame:
    """`query columns, doc, score, rank`: the best documents of each query.

    Scores are rounded to 6 places and ties fall to the smaller `doc`, so the
    order is the same on every run.  Ranks are given before hits without a
    score are dropped.  Query terms are broadcast while they are small.  The
    corpus is cut into tokens once: the frequencies of query terms are written,
    and both document frequencies and scores read them.
    """
    terms = queries.select(*query, F.explode(F.array_distinct(search_tokens(F.col(query_text)))).alias("term"))
    size = queries.agg(F.sum(F.length(query_text))).first()[0] or 0
    small = size <= BROADCAST_TERMS
    tf = written(term_frequencies(corpus, doc, text, terms.select("term").distinct(), small), "tf")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighted = tf.join(F.broadcast(df) if small else df, "term").crossJoin(F.broadcast(corpus_stats(corpus, text)))
    gain = idf("n_docs", "df") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # Partitioned by document, scores are summed and each query's best kept before anything else is shuffled.
    weighted = weighted.select("term", "doc", gain.alias("gain")).repartition("doc")
    hits = weighted.join(F.broadcast(terms) if small else terms, "term").groupBy(*query, "doc").agg(F.round(F.sum("gain"), 6).alias("score"))
    w = Window.partitionBy(*query).orderBy(F.desc("score"), "doc")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).where("score > 0")
