"""Bounded samples of rows to fit a model on, and the spreading of small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, text_col: str, size: int, total: int | None = None) -> DataFrame:
    """The ``size`` rows whose texts come first by hash, or nearly so.

    A threshold on the hash, from the number of rows, thins the rows where they are, so that no
    more than a few times ``size`` are sorted anywhere, however large the input.
    """
    total = rows.count() if total is None else total
    h = F.xxhash64(text_col)
    if total > 4 * size:
        rows = rows.where(h < F.lit(int(-(2**63) + 2**64 * (2.0 * size / total))))
    return rows.withColumn("_hash", h).orderBy("_hash").limit(size).drop("_hash")


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, where the files give fewer parts than there are cores.

    Only a small table is, or one in few large row groups; a table of many parts stays as it is,
    and so does what comes out of a shuffle, as its parts can't be counted without running it.
    """
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
