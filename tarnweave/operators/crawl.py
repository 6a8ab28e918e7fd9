"""A breadth-first crawl, replayed level by level over a table of snapshots.

A crawl in queue order with a budget visits the first ``max_pages`` items of the unbudgeted
breadth-first order (depth, then the parent's place, then the link's place), so each level is
one plan: join the frontier to the snapshots, classify, suppress bad hosts, expand the links,
drop URLs seen before. There are at most ``max_depth`` + 1 levels; nothing but counts is
collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.functions.url import host
from tarnweave.operators.classify import classify, diagnostic, should_penalize
from tarnweave.operators.ordering import dense_ids, first_per_key, suppressed_from
from tarnweave.schemas import QUEUE_ITEM
from tarnweave.session import cut

#: Default parameters of a crawl.
MAX_PAGES, MAX_DEPTH, BAD_HOST_THRESHOLD = 100, 2, 3

Fetch = Callable[[DataFrame], DataFrame]


def snapshot_source(snapshots: DataFrame, fallback: DataFrame | None = None) -> Fetch:
    """Fetches by a join on the requested URL; what the first table lacks may come from the second."""

    def of(df: DataFrame) -> DataFrame:
        return df.select("url", F.coalesce("final_url", "url").alias("final_url"), "status", "content_type", "html").dropDuplicates(["url"])

    def fetch(items: DataFrame) -> DataFrame:
        first = of(snapshots)
        every = first if fallback is None else first.unionByName(of(fallback).join(first.select("url"), "url", "left_anti"))
        return items.join(every, "url", "left")

    return fetch


def seed_items(spark: SparkSession, seeds: list[str]) -> DataFrame:
    if not seeds:
        raise ValueError("at least one seed is needed")
    rows = [(s, s, None, 0) for s in seeds]
    return spark.createDataFrame(rows, QUEUE_ITEM).withColumn("seq", F.monotonically_increasing_id())


def crawl(seeds: DataFrame, fetch: Fetch, *, max_pages: int = MAX_PAGES, max_depth: int = MAX_DEPTH, threshold: int = BAD_HOST_THRESHOLD, suppress: bool = True, now_ms: int | None = None) -> DataFrame:
    """seeds(url, source_seed, referrer, depth, seq) → crawl records with ``seq``, in crawl order.

    Repeated seeds count once; URLs without a host are left out. ``suppress`` off is the legacy
    crawl. An item without a snapshot is a fetch_failed record.
    """
    now = None if now_ms is None else F.lit(now_ms)
    frontier = first_per_key(seeds.where(host(F.col("url")).isNotNull()), ["url"], "seq")
    frontier = cut(dense_ids(frontier.withColumnRenamed("seq", "_order"), "_order", "seq").drop("_order"))
    seen = frontier.select("url")
    done: DataFrame | None = None
    start, counts = 0, None
    for depth in range(max_depth + 1):
        rows = frontier.count()
        if not rows or start >= max_pages:
            break
        budget = frontier.where(F.col("seq") < max_pages)
        got = fetch(budget)
        found = got.where(F.col("final_url").isNotNull()).withColumn("requested_url", F.col("url"))
        records = classify(found.drop("url"), now)
        missing = diagnostic(got.where(F.col("final_url").isNull()), "fetch_failed", "fetch_error", now).join(budget.select("seq", F.col("url").alias("requested_url")), "requested_url")
        level = records.unionByName(missing).withColumn("_host", host(F.col("requested_url")))
        if suppress:
            if counts is not None:
                level = level.join(counts, "_host", "left")
            else:
                level = level.withColumn("penalties", F.lit(0).cast("long"))
            level = suppressed_from(level, "_host", "seq", should_penalize(F.col("skip_reason")), threshold, "penalties").drop("penalties")
            level = _blank_suppressed(level)
        level = cut(level)
        done = level if done is None else done.unionByName(level)
        if suppress:
            bad = level.where(should_penalize(F.col("skip_reason"))).groupBy("_host").agg(F.count("*").alias("penalties"))
            counts = bad if counts is None else counts.unionByName(bad).groupBy("_host").agg(F.sum("penalties").alias("penalties"))
            counts = cut(counts)
        start += rows
        if depth == max_depth:
            break
        links = level.where("outcome = 'stored'").select("source_seed", F.col("final_url").alias("referrer"), (F.col("depth") + 1).alias("depth"), "seq", F.posexplode("links").alias("_pos", "url"))
        links = links.where(host(F.col("url")).isNotNull()).join(seen, "url", "left_anti")
        placed = first_per_key(links.withColumn("_place", F.struct("seq", "_pos")).drop("seq", "_pos"), ["url"], "_place")
        # Places are ordered by the parent first: its number times the longest list of links.
        widest = links.agg(F.max("_pos").alias("m")).first().m or 0
        placed = placed.withColumn("_order", F.col("_place.seq") * F.lit(widest + 1) + F.col("_place._pos")).drop("_place")
        frontier = cut(dense_ids(placed, "_order", "seq", start).drop("_order"))
        seen = seen.unionByName(frontier.select("url"))
    if done is None:
        empty = classify(fetch(seeds).withColumn("requested_url", F.col("url")).drop("url"), now)
        return empty.limit(0)
    return done.drop("_host")


def _blank_suppressed(level: DataFrame) -> DataFrame:
    """Records of suppressed hosts as if they had never been fetched."""
    gone = F.col("suppressed")
    blank = {c: F.when(~gone, F.col(c)) for c in ("final_url", "title", "status", "content_type", "content_length", "content_hash", "content_path")}
    blank["outcome"] = F.when(gone, "host_suppressed").otherwise(F.col("outcome"))
    blank["skip_reason"] = F.when(gone, "bad_host_threshold").otherwise(F.col("skip_reason"))
    blank["extracted_text"] = F.when(gone, "").otherwise(F.col("extracted_text"))
    blank["links"] = F.when(gone, F.array().cast("array<string>")).otherwise(F.col("links"))
    return level.withColumns(blank).drop("suppressed")


def crawl_counts(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("written"), F.sum((F.col("outcome") == "stored").cast("long")).alias("stored"), F.max("depth").alias("deepest"))


def host_suppression(items: DataFrame, *, key: str, order: str, reason: str, threshold: int = BAD_HOST_THRESHOLD) -> DataFrame:
    """Marks the rows that come after their host's ``threshold``-th penalised one."""
    return suppressed_from(items, key, order, should_penalize(F.col(reason)), threshold)
