"""Schemas of the engine's tables, and defaults for missing fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 2
OUTCOMES = ("stored", "skipped", "robots_blocked", "host_suppressed", "fetch_failed")
SKIP_REASONS = ("robots_txt", "non_html", "empty_text", "likely_javascript_required", "fetch_error", "bad_host_threshold")

CRAWL_RECORD = T.StructType(
    [
        T.StructField("schema_version", T.ShortType()),
        T.StructField("requested_url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("source_seed", T.StringType()),
        T.StructField("referrer", T.StringType()),
        T.StructField("depth", T.LongType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("skip_reason", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("content_path", T.StringType()),
        T.StructField("extracted_text", T.StringType()),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("fetched_at_ms", T.LongType()),
    ]
)
#: Fields without which a record is not decodable.
REQUIRED = ("requested_url", "source_seed", "depth", "outcome", "extracted_text", "links", "fetched_at_ms")

QUEUE_ITEM = T.StructType([T.StructField("url", T.StringType()), T.StructField("source_seed", T.StringType()), T.StructField("referrer", T.StringType()), T.StructField("depth", T.LongType())])

CRAWL_EVENT = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("to_url", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("anchor_text", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("extracted_text", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("asset_url", T.StringType()),
        T.StructField("asset_type", T.StringType()),
        T.StructField("alt_text", T.StringType()),
        T.StructField("at", T.TimestampType()),
    ]
)


def with_defaults(records: DataFrame) -> DataFrame:
    """A missing schema_version is 2."""
    return records.withColumn("schema_version", F.coalesce(F.col("schema_version").cast("smallint"), F.lit(SCHEMA_VERSION).cast("smallint")))


def require(records: DataFrame) -> DataFrame:
    """Fails on a record that lacks a required field, or whose outcome or reason is unknown."""
    checks = [F.assert_true(F.col(c).isNotNull(), F.lit(f"missing field: {c}")) for c in REQUIRED]
    checks.append(F.assert_true(F.col("outcome").isin(*OUTCOMES), F.lit("unknown outcome")))
    checks.append(F.assert_true(F.col("skip_reason").isNull() | F.col("skip_reason").isin(*SKIP_REASONS), F.lit("unknown skip_reason")))
    passed = F.array(*[c.isNull() for c in checks])
    return records.where(F.size(passed) > 0)
