"""Numbers and running values along an order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 100_000


def dense_ids(df: DataFrame, order: str, name: str = "id", start: int = 0) -> DataFrame:
    """Numbers the rows by a whole-number column: ``start``, ``start``+1, ... in its order.

    The range of the column is cut into buckets of about BUCKET_ROWS rows, fewer if that leaves
    partitions of the shuffle without any; rows are numbered inside their bucket, and a table of one row per bucket holds the offsets. Ties are broken
    by the rows' other columns' hash, null orders come last in a bucket of their own.
    """
    stats = df.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n")).first()
    low, high = stats.low or 0, stats.high or 0
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = min(BUCKET_ROWS, stats.n // (4 * wide) + 1)
    width = max(1, (high - low + 1) * rows // max(1, stats.n))
    bucket = F.coalesce(F.floor((F.col(order) - F.lit(low)) / F.lit(width)), F.lit(2**60)).cast("long")
    placed = df.withColumn("_bucket", bucket)
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(F.col(order).asc_nulls_last(), F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]))
    return placed.join(before, "_bucket").withColumn(name, F.col("_before") + F.row_number().over(inside) - 1 + start).drop("_bucket", "_before")


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key, by aggregation (combined before the shuffle)."""
    rest = [c for c in df.columns if c not in keys and c != order]
    best = F.max_by(F.struct(order, *rest), F.col(order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c != order]
    best = F.min_by(F.struct(order, *rest), F.col(order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def suppressed_from(df: DataFrame, host: str, order: str, penalised: Column, threshold: int, start: str | None = None) -> DataFrame:
    """Adds ``suppressed``: the host had ``threshold`` penalised rows before this one.

    Only the order value of the threshold-th penalised row of each host matters, so hosts are
    reduced to their first ``threshold`` penalised rows (a window limit works before the
    shuffle) and joined back; a host of any size is never one task's window. ``start`` names a
    column with penalties counted earlier.
    """
    marked = df.withColumn("_bad", penalised)
    done = F.coalesce(F.col(start), F.lit(0)) if start else F.lit(0)
    bad = marked.where("_bad").select(host, order, done.alias("_done"))
    ranked = bad.withColumn("_n", F.row_number().over(Window.partitionBy(host).orderBy(order))).where(F.col("_n") <= threshold)
    limit = ranked.where(F.col("_n") + F.col("_done") == threshold).select(host, F.col(order).alias("_from"))
    out = marked.join(limit, host, "left")
    return out.withColumn("suppressed", (done >= threshold) | F.coalesce(F.col(order) > F.col("_from"), F.lit(False))).drop("_bad", "_from")
