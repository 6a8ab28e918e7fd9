"""Building the search index: documents, postings, terms and corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.functions.text import raw_words, tokenize, trim_unicode
from tarnweave.operators.ordering import dense_ids, first_per_key
from tarnweave.session import cut


@dataclass
class SearchIndex:
    """documents(id, url, title, text, token_count, page_rank), postings(term, id, tf), terms(term, document_frequency), stats(documents, average_doc_len)."""

    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def persist(self) -> SearchIndex:
        return SearchIndex(self.documents.persist(), self.postings.persist(), self.terms.persist(), self.stats.persist())


def indexable(records: DataFrame) -> DataFrame:
    return records.where((F.col("outcome") == "stored") & (F.coalesce(trim_unicode("extracted_text"), F.lit("")) != "") & F.col("final_url").isNotNull())


def postings_of(documents: DataFrame) -> DataFrame:
    """(term, id, tf) of documents(id, tokens)."""
    return documents.select("id", F.explode("tokens").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("document_frequency"))


def corpus_stats(documents: DataFrame) -> DataFrame:
    """One row: documents, and their mean length (documents without tokens count; 0 if there are none)."""
    return documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("token_count") / F.count("*"), F.lit(0.0)).alias("average_doc_len"))


def index_texts(texts: DataFrame, *, id_col: str, text_col: str) -> SearchIndex:
    """An index of a plain table of texts, every rank being 1."""
    docs = texts.select(F.col(id_col).alias("id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("title"), F.col(text_col).alias("text"), tokenize(F.col(text_col)).alias("tokens")).where("id is not null")
    docs = docs.withColumn("token_count", F.size("tokens").cast("long")).withColumn("page_rank", F.lit(1.0))
    postings = postings_of(docs)
    return SearchIndex(docs.drop("tokens"), postings, document_frequency(postings), corpus_stats(docs))


def build_index(records: DataFrame, ranks: DataFrame | None = None) -> SearchIndex:
    """Index of crawl records(seq, ...): ids count from 0 in the order of seq; a URL without a rank has 1."""
    chosen = indexable(records).select("seq", F.col("final_url").alias("url"), "title", F.col("extracted_text").alias("text"))
    numbered = dense_ids(chosen, "seq").drop("seq").withColumn("tokens", tokenize(F.col("text"))).withColumn("token_count", F.size("tokens").cast("long"))
    numbered = cut(numbered)  # documents, postings and statistics all come of it
    postings = postings_of(numbered)  # without the ranks, which they don't need
    if ranks is None:
        ranked = numbered.withColumn("page_rank", F.lit(1.0))
    else:
        ranked = numbered.join(ranks.select("url", "page_rank"), "url", "left").withColumn("page_rank", F.coalesce("page_rank", F.lit(1.0)))
    docs = ranked.select("id", "url", "title", "text", "token_count", "page_rank")
    return SearchIndex(docs, postings, document_frequency(postings), corpus_stats(numbered))


def stored_index(indexed: DataFrame) -> SearchIndex:
    """An index from stored documents with their term maps; a repeated id counts once, stored frequencies aren't trusted."""
    docs = indexed.where("id is not null").select("id", "url", "title", "text", "token_count", "page_rank", F.map_entries("term_freqs").alias("freqs"))
    docs = docs.groupBy("id").agg(F.max(F.struct(F.col("freqs").isNotNull().alias("_has"), F.coalesce("token_count", F.lit(0)).alias("token_count"), "url", "title", "text", "page_rank", "freqs")).alias("d")).select("id", "d.*")
    postings = docs.select("id", F.explode("freqs").alias("e")).select(F.col("e.key").alias("term"), "id", F.col("e.value").cast("long").alias("tf")).where("tf > 0")
    docs = docs.select("id", "url", "title", "text", F.col("token_count").cast("long").alias("token_count"), F.coalesce("page_rank", F.lit(1.0)).alias("page_rank"))
    return SearchIndex(docs, postings, document_frequency(postings), corpus_stats(docs))


def health(index: SearchIndex) -> DataFrame:
    """One row: status, documents, terms."""
    return index.stats.select(F.lit("ok").alias("status"), "documents").crossJoin(index.terms.agg(F.count("*").alias("terms")))


def legacy_pages_to_index(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """(page_id, text): pages with an extracted text."""
    text = first_per_key(contents.where("extracted_text is not null and page_id is not null").select("page_id", "stored_at", "extracted_text"), ["page_id"], "stored_at")
    return pages.where("id is not null").select(F.col("id").alias("page_id")).distinct().join(text, "page_id").select("page_id", F.col("extracted_text").alias("text"))


def legacy_postings(texts: DataFrame) -> DataFrame:
    """(term, page_id, term_frequency): words as they stand between white space."""
    return texts.select("page_id", F.explode(raw_words(F.col("text"))).alias("term")).groupBy("term", "page_id").agg(F.count("*").alias("term_frequency"))


def legacy_terms(postings: DataFrame) -> DataFrame:
    """The term dictionary; ids are hashes of the terms, which needs no order over all of them."""
    return postings.select("term").distinct().select(F.xxhash64("term").alias("id"), "term")


def legacy_document_stats(texts: DataFrame) -> DataFrame:
    words = raw_words(F.col("text"))
    return texts.select("page_id", F.size(words).cast("long").alias("word_count"), F.size(F.array_distinct(words)).cast("long").alias("unique_terms"))
