"""Ranked retrieval over an index, one query or many at a time."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnweave.functions import text as X
from tarnweave.operators.index import SearchIndex

MAX_RESULTS, DEFAULT_RESULTS = 50, 10
#: Scores are compared at this many digits, so that ties are cut alike wherever sums are added up.
DIGITS = 6
#: Query terms up to which they are broadcast.
BROADCAST_TERMS = 100_000


def _query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): a repeated term counts repeatedly."""
    return queries.select("query_id", F.explode(X.tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _scores(index: SearchIndex, queries: DataFrame, small: bool) -> DataFrame:
    wanted = _query_terms(queries).join(index.terms, "term") if not small else index.terms.join(F.broadcast(_query_terms(queries)), "term")
    wanted = F.broadcast(wanted) if small else wanted
    rows = index.postings.join(wanted, "term")
    if "token_count" not in index.postings.columns:  # a stored index has lengths and ranks in its postings
        rows = rows.join(index.documents.select("id", "token_count", "page_rank"), "id")
    rows = rows.crossJoin(F.broadcast(index.stats))  # stats is one row
    args = (F.col("tf"), F.col("token_count"))
    bm25 = F.col("qtf") * X.bm25(*args, F.col("average_doc_len"), F.col("documents"), F.col("document_frequency"))
    tfidf = F.col("qtf") * X.tfidf(*args, F.col("documents"), F.col("document_frequency"))
    sums = rows.groupBy("query_id", "id").agg(F.sum(bm25).alias("bm25_score"), F.sum(tfidf).alias("tfidf_score"), F.first("page_rank").alias("page_rank"))
    score = F.round((F.col("bm25_score") + F.col("tfidf_score")) * F.greatest("page_rank", F.lit(0.1)), DIGITS)
    return sums.select("query_id", "id", score.alias("score"), F.round("bm25_score", DIGITS).alias("bm25_score"), F.round("tfidf_score", DIGITS).alias("tfidf_score"), F.round("page_rank", DIGITS).alias("page_rank")).where("score > 0")


def search(spark: SparkSession, index: SearchIndex, query: str, top_k: int = DEFAULT_RESULTS, mode: str = "traditional", snippets: bool = True) -> DataFrame:
    """(id, url, title, snippet, score, bm25_score, tfidf_score, page_rank), best first.

    At most 50 rows; ties go to the smaller id. A query of stop words only has no results.
    Snippets are made for the rows that are returned.
    """
    if mode != "traditional":
        raise ValueError(f"unknown search mode: {mode}")
    queries = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("query"))
    words = [r.term for r in _query_terms(queries).select("term").collect()]  # those of the query
    mine = replace(index, postings=index.postings.where(F.col("term").isin(words)), terms=index.terms.where(F.col("term").isin(words)))
    best = _scores(mine, queries, True).orderBy(F.desc("score"), "id").limit(max(0, min(top_k, MAX_RESULTS))).drop("query_id")
    found = best.collect()  # MAX_RESULTS rows at most; with their ids a stored index reads few row groups of documents
    top = spark.createDataFrame(found, best.schema)
    rows = index.documents.select("id", "url", "title", "text").where(F.col("id").isin([r.id for r in found])).join(F.broadcast(top), "id")
    terms = X.tokenize(F.lit(query))
    shown = X.snippet(F.coalesce("text", F.lit("")), terms) if snippets else F.lit(None).cast("string")
    return rows.select("id", "url", "title", shown.alias("snippet"), "score", "bm25_score", "tfidf_score", "page_rank").orderBy(F.desc("score"), "id")


def search_many(index: SearchIndex, queries: DataFrame, top_k: int = DEFAULT_RESULTS) -> DataFrame:
    """queries(query_id, query) → (query_id, rank, id, score, bm25_score, tfidf_score, page_rank)."""
    small = queries.select(F.sum(F.length("query"))).first()[0] or 0
    scored = _scores(index, queries, small < BROADCAST_TERMS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= min(top_k, MAX_RESULTS)).select("query_id", "rank", "id", "score", "bm25_score", "tfidf_score", "page_rank")


def legacy_query_terms(query: str, stop_words: list[str] | None = None) -> list[str]:
    """Normalised query words without stop words, each once; raises if none is left."""
    stop = set(StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words)
    words = ["".join(c.lower() for c in w if c.isalnum()) for w in query.split()]
    terms = list(dict.fromkeys(w for w in words if w and w not in stop))
    if not terms:
        raise ValueError("no valid terms in search query")
    return terms


def legacy_search(spark: SparkSession, tables: dict[str, DataFrame], query: str, top_k: int = DEFAULT_RESULTS, stop_words: list[str] | None = None) -> DataFrame:
    """(page_id, url, title, score) from pages, terms, postings, document_stats and page_rank, through SQL.

    tables: pages(id, url, title) one row per id; terms(id, term); postings(term_id, page_id,
    term_frequency); document_stats(page_id, word_count); page_rank(page_id, rank). All pages
    count as documents; rows with a score of 0 stay; there is no cap.
    """
    terms = legacy_query_terms(query, stop_words)
    sql = """
        WITH wanted AS (SELECT id, term FROM {terms} WHERE array_contains(:words, term)),
        matched AS (SELECT p.term_id, p.page_id, p.term_frequency FROM {postings} p JOIN wanted w ON p.term_id = w.id),
        frequency AS (SELECT term_id, count(*) AS document_frequency FROM matched GROUP BY term_id),
        total AS (SELECT count(*) AS pages FROM {pages})
        SELECT g.id AS page_id, g.url, g.title,
               round(sum(m.term_frequency / s.word_count * ln((t.pages + 1.0D) / (f.document_frequency + 1.0D)) * coalesce(r.rank, 1.0D)), 6) AS score
        FROM matched m
        JOIN frequency f ON m.term_id = f.term_id
        JOIN {pages} g ON m.page_id = g.id
        JOIN {stats} s ON m.page_id = s.page_id
        LEFT JOIN {ranks} r ON m.page_id = r.page_id
        CROSS JOIN total t
        WHERE s.word_count > 0
        GROUP BY g.id, g.url, g.title
        ORDER BY score DESC, page_id
        LIMIT :k
    """
    return spark.sql(sql, args={"words": F.array(*[F.lit(t) for t in terms]), "k": int(top_k)}, terms=tables["terms"], postings=tables["postings"], pages=tables["pages"], stats=tables["document_stats"], ranks=tables["page_rank"])


def result_lines(results: DataFrame) -> DataFrame:
    """(rank, line): numbered lines for a terminal."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "page_id"))  # at most top_k rows
    return results.withColumn("rank", rank).select("rank", X.result_line(F.col("rank"), F.col("title"), F.col("url"), F.col("score")).alias("line"))
