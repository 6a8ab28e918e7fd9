"""The queries of the training-data operators, as (spark, directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.session import table


def p1_scores(spark: SparkSession, sf: str) -> DataFrame:
    from tarnweave.llm.residue import residue_scores

    return residue_scores(table(spark, sf, "crawl_records"), id_col="seq", text_col="extracted_text", status_col="status", url_col="final_url")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_scores(spark, sf).where("residue").select("seq")


def p1_templates(spark: SparkSession, sf: str) -> DataFrame:
    from tarnweave.llm.residue import mine_templates

    return mine_templates(table(spark, sf, "crawl_records"), "extracted_text", "status", "final_url")


def p2_scores(spark: SparkSession, sf: str) -> DataFrame:
    from tarnweave.llm.stuffing import fit_prose_model, stuffing_scores

    model = fit_prose_model(table(spark, sf, "documents"), text_col="text", language_col="lang")
    stored = table(spark, sf, "crawl_records").where(F.col("outcome") == "stored")
    return stuffing_scores(stored, model, id_col="seq", text_col="extracted_text", links_col="links")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_scores(spark, sf).where("stuffed").select("seq")


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    from tarnweave.llm.langid import fit_filters, language_segments

    filters = fit_filters(table(spark, sf, "documents"))
    stored = table(spark, sf, "crawl_records").where(F.col("outcome") == "stored")
    return language_segments(stored, filters, id_col="seq", text_col="extracted_text")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    from tarnweave.llm.langid import unhinted_languages

    return unhinted_languages(_segments(spark, sf), table(spark, sf, "lang_hints"), id_col="seq", hint_col="lang_hint")


def p3_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf)


def p3_languages(spark: SparkSession, sf: str) -> DataFrame:
    from tarnweave.llm.langid import document_languages

    return document_languages(_segments(spark, sf), "seq")


#: Pairs and the groups they form: runs of three words, a similarity of 0.6, 50 words or more.
_SIMILAR = {"id_col": "seq", "text_col": "extracted_text", "n": 3, "threshold": 0.6, "min_words": 50}


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from tarnweave.llm.neardup import near_duplicate_pairs

    records = table(spark, sf, "crawl_records")
    pairs = near_duplicate_pairs(records, **_SIMILAR, where=F.col("outcome") == "stored")
    return pairs.select(F.col("id_a").alias("seq_a"), F.col("id_b").alias("seq_b"))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    from tarnweave.llm.neardup import near_duplicate_groups

    records = table(spark, sf, "crawl_records")
    return near_duplicate_groups(records, **_SIMILAR, where=F.col("outcome") == "stored").withColumnRenamed("doc", "seq")


def p6_blocks(spark: SparkSession, sf: str) -> DataFrame:
    from tarnweave.llm.boilerplate import main_blocks

    return main_blocks(table(spark, sf, "page_contents"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_blocks(spark, sf).select("page_id", "block_md5").distinct()


def p6_flat(spark: SparkSession, sf: str) -> DataFrame:
    from tarnweave.llm.boilerplate import flat_main_text

    return flat_main_text(table(spark, sf, "crawl_records"), id_col="seq", text_col="extracted_text")


def p7_terms(spark: SparkSession, sf: str) -> DataFrame:
    from tarnweave.llm.vocab import marked_terms

    return marked_terms(table(spark, sf, "indexed_documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_terms(spark, sf).where("term_mark is not null").select("term", "term_mark")


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    from tarnweave.llm.leakage import leaked_passages

    return leaked_passages(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    from tarnweave.llm.leakage import leaked_passages

    leaks = leaked_passages(table(spark, sf, "documents"), table(spark, sf, "eval_items"), edits=0)
    return leaks.where("run_words >= 12").select("doc_id", "item_id")


def _mixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from tarnweave.llm.mixing import mix_sources, with_token_counts
    from tarnweave.session import cut

    sized = cut(with_token_counts(table(spark, sf, "documents").select("doc_id", "source", "text"), "text").drop("text"))
    return mix_sources(sized, table(spark, sf, "source_targets"))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf)[0].select("doc_id", "source", "copy", F.col("size").alias("n_tokens"), "finish")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf)[1]


def _mixture_by_characters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from tarnweave.llm.mixing import mix_sources

    sized = table(spark, sf, "documents").select("doc_id", "source", F.char_length("text").alias("n_tokens"))
    return mix_sources(sized, table(spark, sf, "source_targets"))


def p9_shares_by_characters(spark: SparkSession, sf: str) -> DataFrame:
    shares = _mixture_by_characters(spark, sf)[1]
    return shares.select("source", F.round("target_share", 6).alias("target_share"), F.round("goal_share", 6).alias("goal_share"), F.col("tokens").alias("n_chars"), F.round("share", 6).alias("share"), "documents", "uses")


def p9_by_characters(spark: SparkSession, sf: str) -> DataFrame:
    """The same mixture with sizes in characters."""
    return _mixture_by_characters(spark, sf)[0].select("doc_id", "source", "copy", F.col("size").alias("n_chars"), F.round("finish", 3).alias("finish"))


def _endings(spark: SparkSession, sf: str) -> DataFrame:
    from tarnweave.llm.truncation import ending_scores, language_bucket

    return ending_scores(table(spark, sf, "documents"), language=language_bucket(F.col("lang")), keep=["source"])


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _endings(spark, sf).where("truncated").select("doc_id")


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    from tarnweave.llm.mixing import source_name
    from tarnweave.llm.truncation import truncation_rates

    return truncation_rates(_endings(spark, sf), F.coalesce(source_name(F.col("source")), F.lit("(none)")))


NAMES = ["p6_blocks", "p6_found", "p6_flat", "p1_scores", "p1_found", "p1_templates", "p2_scores", "p2_found", "p3_found", "p3_segments", "p3_languages", "p4_found", "p4_groups", "p7_terms", "p7_found", "p8_leaks", "p8_found", "p9_mixture", "p9_shares", "p9_by_characters", "p9_shares_by_characters", "p10_found", "p10_rates"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}
