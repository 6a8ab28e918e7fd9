"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a random but repeatable order. A document's virtual finish
time is its source's cumulative size up to and including it, divided by the source's target
weight; a repeat of the source starts where the last one ended. Taking documents by finish time
serves every source in proportion to its weight, and the first documents whose sizes fill the
budget are the mixture.

A running total over one source, or over everything, would be one task. Both are done in two
levels: sums of small buckets first, then a running total inside each bucket. Documents that finish
later than the budget allows are left out before they are repeated; the rest is range-sorted.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.session import cut

#: Documents that share a bucket, on average, if one source held everything; and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 256


def default_vocabulary() -> str:
    """Path of the public byte-level vocabulary, where the package with the files is installed."""
    spec = importlib.util.find_spec("public_tokenizers")
    root = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(root, "byte_bpe_50k.tiktoken")


#: The splitting pattern published with the vocabulary (fixed value).
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def with_token_counts(df: DataFrame, text_col: str, vocabulary: str | None = None, out_col: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each text; null counts as 0."""
    path = vocabulary or default_vocabulary()
    df.sparkSession.sparkContext.addFile(path)  # sent to the executors, which needn't have it
    name = os.path.basename(path)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return df.withColumn(out_col, count(F.col(text_col)))


def source_name(col: Column) -> Column:
    """One name for all spellings: trimmed, lower-cased, runs of other signs as one underscore."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[^\p{L}\p{N}]+", "_")


def _finish_of(weights: list[tuple[float, float]], size: float) -> float:
    """The finish time at which sources of (weight, all they can give) have given ``size``, or all; a row per source."""
    left, active = size, sum(w for w, _ in weights)
    time = 0.0
    for end, w in sorted((full / w, w) for w, full in weights):
        if left <= (end - time) * active:
            return time + left / active
        left -= (end - time) * active
        time, active = end, active - w
    return time


def mix_sources(docs: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_tokens", budget: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Returns ``(chosen, shares)``.

    chosen(doc_id, source, copy, size, finish): a document once for each copy that is in the
    mixture, copy counting from 1 and never above the source's max_repeats. shares(source,
    target_share, goal_share, tokens, share, documents, uses): one row per target source.

    budget: total size; by default the largest at which no source with documents runs out
    before the others, so that every goal share can be met. goal_share is target_share among
    the sources that have documents. Sources without a target, null sources, null ids and empty
    documents aren't used; a null or non-positive share or repeat count means that the source
    isn't wanted; ties of finish time are broken by source, copy and id; repeated ids are separate documents;
    an empty side gives an empty mixture.
    """
    wanted = targets.select(source_name(F.col("source")).alias("src"), "target_share", "max_repeats").where("src is not null and target_share > 0 and max_repeats > 0")
    wanted = wanted.groupBy("src").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))), 1, 10), 16, 10).cast("long")
    placed = docs.select(F.col(id_col).alias("id"), source_name(F.col(source_col)).alias("src"), F.col(size_col).cast("long").alias("size"), u.alias("u"))
    placed = placed.where("id is not null and src is not null and size > 0")
    buckets = max(LEAST_BUCKETS, docs.count() // BUCKET_ROWS)
    placed = placed.withColumn("bucket", F.floor(F.col("u") / F.lit(1 << 40) * buckets))
    sums = placed.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"))
    order = Window.partitionBy("src").orderBy("bucket")
    offsets = sums.select("src", "bucket", (F.sum("bucket_size").over(order) - F.col("bucket_size")).alias("before"), F.sum("bucket_size").over(Window.partitionBy("src")).alias("source_size"))
    # offsets and wanted are tables of a row per target source and bucket: bounded by the
    # declared targets, not by the documents.
    plan = offsets.join(wanted, "src")
    plan = cut(plan)
    # A row per target source.
    largest = placed.groupBy("src").agg(F.max("size").alias("largest"))
    sources = plan.select("src", "source_size", "target_share", "max_repeats").distinct().join(largest, "src").collect()
    weights = [(float(r.target_share), float(r.source_size * r.max_repeats)) for r in sorted(sources, key=lambda r: r.src)]
    if budget is None:
        budget = min((full / w for w, full in weights), default=0.0) * sum(w for w, _ in weights)
    # Later documents can't be in: up to here the sources have the budget, and their last documents besides.
    latest = _finish_of(weights, budget + sum(r.largest for r in sources))
    inside = Window.partitionBy("src", "bucket").orderBy("u", "id").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.join(plan, ["src", "bucket"]).withColumn("at", F.col("before") + F.sum("size").over(inside))
    uses = F.least(F.col("max_repeats"), F.floor((F.lit(latest) * F.col("target_share") - F.col("at")) / F.col("source_size")) + 1).cast("int")
    copies = running.withColumn("uses", uses).where("uses > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    timed = copies.select("id", "src", "copy", "size", (((F.col("copy") - 1) * F.col("source_size") + F.col("at")) / F.col("target_share")).alias("finish"))
    # One global order by ranges of finish times; where a row lies is written with it.
    wide = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 4)
    slots = cut(timed.repartitionByRange(wide, "finish", "src", "copy", "id").withColumn("slot", F.spark_partition_id()))
    slot_sums = slots.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    # One task over a row per range.
    slot_before = slot_sums.select("slot", (F.sum("slot_size").over(Window.orderBy("slot")) - F.col("slot_size")).alias("slot_before"))
    in_slot = Window.partitionBy("slot").orderBy("finish", "src", "copy", "id").rowsBetween(Window.unboundedPreceding, 0)
    total = slots.join(F.broadcast(slot_before), "slot").where(F.col("slot_before") < F.lit(budget)).withColumn("total", F.col("slot_before") + F.sum("size").over(in_slot))
    chosen = total.where(F.col("total") <= F.lit(budget)).select(F.col("id").alias("doc_id"), F.col("src").alias("source"), "copy", "size", "finish")
    per = chosen.groupBy("source").agg(F.sum("size").alias("tokens"), F.count_distinct("doc_id").alias("documents"), F.count("*").alias("uses"))
    have = plan.select(F.col("src").alias("source"), F.lit(True).alias("has")).distinct()
    goal = wanted.withColumnRenamed("src", "source").join(have, "source", "left")
    every = Window.partitionBy()
    shares = goal.join(per, "source", "left").select("source", "target_share", (F.when(F.col("has"), F.col("target_share")).otherwise(0.0) / F.sum(F.when(F.col("has"), F.col("target_share"))).over(every)).alias("goal_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("tokens", F.lit(0)) / F.sum("tokens").over(every)).alias("share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("uses", F.lit(0)).alias("uses"))
    return chosen, shares
