"""Upserts without a table format: each is a plan from the old table and the changes to the new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.operators.ordering import dense_ids, first_per_key, last_per_key


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins: the newest row of each key among the changes, else the old row."""
    fresh = last_per_key(new, keys, order)
    if old is None:
        return fresh
    return old.join(fresh, keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def insert_ignore(old: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First write wins: rows of keys that the table has already are dropped."""
    fresh = first_per_key(new, keys, order)
    if old is None:
        return fresh
    return old.unionByName(fresh.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def enqueue_new(seen: DataFrame | None, items: DataFrame, order: str) -> DataFrame:
    """Queue items whose URL was never seen, each once, the first one."""
    fresh = first_per_key(items.withColumn("url_hash", url_hash(F.col("url"))), ["url_hash"], order)
    return fresh if seen is None else fresh.join(seen.select("url_hash"), "url_hash", "left_anti")


def status_update(urls: DataFrame, records: DataFrame, order: str) -> DataFrame:
    """urls(url_hash, status) with the outcome of the newest record of each URL."""
    new = last_per_key(records.select(url_hash(F.col("requested_url")).alias("url_hash"), "outcome", order), ["url_hash"], order)
    return urls.join(new, "url_hash", "left").select("url_hash", F.coalesce("outcome", "status").alias("status"))


def content_store(records: DataFrame, stored_only: bool = True) -> DataFrame:
    """(content_hash, html): each content once, whatever number of pages has it."""
    rows = records.where("outcome = 'stored'") if stored_only else records
    return rows.where("content_hash is not null").groupBy("content_hash").agg(F.min("html").alias("html"))


def page_ids(old: DataFrame | None, urls: DataFrame, order: str) -> DataFrame:
    """(id, url): ids of known URLs stay; new ones get the next ids in first-seen order."""
    first = urls.groupBy("url").agg(F.min(order).alias(order))
    if old is None:
        return dense_ids(first, order, start=1).select("id", "url")
    start = (old.agg(F.max("id").alias("m")).first().m or 0) + 1
    fresh = first.join(old.select("url"), "url", "left_anti")
    return old.select("id", "url").unionByName(dense_ids(fresh, order, start=start).select("id", "url"))


def apply_page_events(events: DataFrame) -> DataFrame:
    """pages(url, status, http_status, content_type, title, error, first_seq: a number in the order of creation) after events(seq, kind, url, to_url, ...).

    A page exists from the first event that queues it, links to it or finds something in it.
    Fetched and failed events change pages that exist, the last one holding: a failure keeps
    what a fetch had set, a fetch clears the error. Events without a url are ignored.
    """
    # Both pages of a link are made by one event, first the one that links.
    makes = events.where(~F.col("kind").isin("page_fetched", "page_failed"))
    made = makes.select("url", (F.col("seq") * 2).alias("seq")).unionByName(makes.where("kind = 'link_found'").select(F.col("to_url").alias("url"), (F.col("seq") * 2 + 1).alias("seq"))).where("url is not null").groupBy("url").agg(F.min("seq").alias("first_seq"))
    own = events.where(F.col("kind").isin("page_fetched", "page_failed")).select("url", "seq", "kind", "http_status", "content_type", "title", "error")
    fetched, failed = F.col("kind") == "page_fetched", F.col("kind") == "page_failed"
    after = F.when(F.col("seq") * 2 > F.col("first_seq"), F.col("seq"))

    def last(value: Column, when: Column) -> Column:
        return F.max_by(F.struct(value.alias("v")), F.when(when, after))["v"]

    return made.join(own, "url", "left").groupBy("url").agg(
        F.coalesce(last(F.when(fetched, "fetched").otherwise("failed"), fetched | failed), F.lit("queued")).alias("status"),
        last(F.col("http_status"), fetched).alias("http_status"),
        last(F.col("content_type"), fetched).alias("content_type"),
        last(F.col("title"), fetched).alias("title"),
        last(F.when(failed, F.col("error")), fetched | failed).alias("error"),
        F.first("first_seq").alias("first_seq"),
    )


def apply_events(events: DataFrame) -> dict[str, DataFrame]:
    """The legacy tables after a batch of crawl events: one filter and one merge for each kind."""
    pages = apply_page_events(events)
    ids = page_ids(None, pages.select("url", F.col("first_seq").alias("seq")), "seq")
    known = pages.join(ids, "url").select("id", "url", "status", "http_status", "content_type", "title", "error")
    found = first_per_key(events.where("kind = 'link_found'").select("url", "to_url", "seq", "anchor_text"), ["url", "to_url"], "seq")
    links = found.join(ids.select(F.col("id").alias("from_page_id"), "url"), "url").join(ids.select(F.col("id").alias("to_page_id"), F.col("url").alias("to_url")), "to_url").select("from_page_id", "to_page_id", "anchor_text")
    contents = last_per_key(events.where("kind = 'page_content_found'").select("url", "seq", "html", "extracted_text", "content_hash"), ["url"], "seq").join(ids, "url").select(F.col("id").alias("page_id"), "html", "extracted_text", "content_hash")
    assets = last_per_key(events.where("kind = 'asset_found'").select("url", "asset_url", "seq", "asset_type", "alt_text"), ["url", "asset_url"], "seq").join(ids, "url").select(F.col("id").alias("page_id"), "asset_url", "asset_type", "alt_text")
    return {"pages": known, "links": links, "page_contents": contents, "page_assets": assets}


def expire(df: DataFrame, at_ms: str, days: int, now_ms: Column | None = None) -> DataFrame:
    """Rows not older than so many days."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    return df.where(F.col(at_ms) >= now - F.lit(days * 86_400_000))
