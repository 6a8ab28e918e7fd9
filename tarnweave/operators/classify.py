"""Page classification: which snapshot becomes which crawl record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.functions import html as H
from tarnweave.functions.text import ascii_lower, content_hash, content_path, trim_unicode

MIN_TEXT_CHARS = 80
PENALISED = ("non_html", "empty_text", "likely_javascript_required", "fetch_error")


def is_html(content_type: Column, html: Column) -> Column:
    """By content type where there is one; else by how the page begins (in this case only) or an html tag."""
    start = F.regexp_replace(html, r"^\p{IsWhite_Space}+", "")
    guess = start.startswith("<!doctype html") | html.contains("<html")
    return F.when(content_type.isNotNull(), ascii_lower(content_type).contains("text/html")).otherwise(F.coalesce(guess, F.lit(False)))


def text_chars(text: Column) -> Column:
    return F.char_length(trim_unicode(F.coalesce(text, F.lit(""))))


def javascript_required(html: Column, text: Column) -> Column:
    page, said = ascii_lower(F.coalesce(html, F.lit(""))), ascii_lower(F.coalesce(text, F.lit("")))
    marks = (F.regexp_count(page, F.lit("<script")) >= 3) | said.contains("enable javascript") | said.contains("requires javascript") | said.contains("please enable js") | page.contains('id="__next"') | page.contains('id="root"')
    return (text_chars(text) < MIN_TEXT_CHARS) & marks


def empty_text(text: Column) -> Column:
    return text_chars(text) < MIN_TEXT_CHARS


def skip_reason(content_type: Column, html: Column, text: Column) -> Column:
    """The first reason that holds, or null; the HTTP status plays no part."""
    return F.when(~is_html(content_type, html), "non_html").when(javascript_required(html, text), "likely_javascript_required").when(empty_text(text), "empty_text")


def should_penalize(reason: Column) -> Column:
    return F.coalesce(reason.isin(*PENALISED), F.lit(False))


def classify(snapshots: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """snapshots(requested_url, final_url, source_seed, referrer, depth, status, content_type, html) → crawl records.

    A skipped record keeps its text and links but has no title, hash or path. A null html is an
    empty page; a missing final URL is the requested one. Other columns are passed through.
    """
    final = F.coalesce("final_url", "requested_url")
    page = snapshots.withColumn("final_url", final).withColumn("_p", H.extract("html", "final_url"))
    reason = skip_reason(F.col("content_type"), F.coalesce("html", F.lit("")), F.col("_p.text"))
    rows = page.withColumn("skip_reason", reason)
    stored = F.col("skip_reason").isNull()
    digest = content_hash(F.coalesce("html", F.lit("")))
    other = [c for c in snapshots.columns if c not in ("requested_url", "final_url", "source_seed", "referrer", "depth", "status", "content_type", "html", "title", "links", "skip_reason", "outcome")]
    return rows.select(
        *other,
        F.lit(2).cast("smallint").alias("schema_version"),
        "requested_url",
        "final_url",
        "source_seed",
        "referrer",
        F.col("depth").cast("long").alias("depth"),
        F.when(stored, "stored").otherwise("skipped").alias("outcome"),
        "skip_reason",
        F.when(stored, F.col("_p.title")).alias("title"),
        F.col("status").cast("int").alias("status"),
        "content_type",
        F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("content_length"),
        F.when(stored, digest).alias("content_hash"),
        F.when(stored, content_path(digest)).alias("content_path"),
        F.col("_p.text").alias("extracted_text"),
        F.col("_p.links").alias("links"),
        (F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms).cast("long").alias("fetched_at_ms"),
    )


def diagnostic(items: DataFrame, outcome: str, reason: str | None, now_ms: Column | None = None) -> DataFrame:
    """Records of items that were never fetched: request fields only, empty text, no links."""
    empty = {"final_url": "string", "title": "string", "status": "int", "content_type": "string", "content_length": "long", "content_hash": "string", "content_path": "string"}
    return items.select(
        F.lit(2).cast("smallint").alias("schema_version"),
        F.col("url").alias("requested_url"),
        "source_seed",
        "referrer",
        F.col("depth").cast("long").alias("depth"),
        F.lit(outcome).alias("outcome"),
        F.lit(reason).cast("string").alias("skip_reason"),
        *[F.lit(None).cast(t).alias(c) for c, t in empty.items()],
        F.lit("").alias("extracted_text"),
        F.array().cast("array<string>").alias("links"),
        (F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms).cast("long").alias("fetched_at_ms"),
    )


def legacy_outcome(status: Column, content_type: Column) -> Column:
    """'failed' outside 2xx, null for what isn't HTML (no event at all), else 'fetched'."""
    return F.when(~F.coalesce(status.between(200, 299), F.lit(False)), "failed").when(F.coalesce(content_type, F.lit("")).contains("text/html"), "fetched")


def outcome_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("outcome", "skip_reason").agg(F.count("*").alias("records"), F.sum((F.col("outcome") == "stored").cast("long")).alias("stored"))
