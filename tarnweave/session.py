"""Session helpers: table access and lineage cuts that survive a lost executor."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, as the driver lays them out."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of this session.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, a laptop)
    is a temporary folder made, and only for a local master: executors on other machines could
    not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    current = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if current:
        return current
    made = os.path.join(tempfile.gettempdir(), f"tarnweave-{os.getpid()}")
    os.makedirs(made, exist_ok=True)
    return made


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=eager)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package's code to the executors, once per application.

    Functions that run in Python workers are pickled by name, so the workers must be able to
    import them wherever the session was started.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tarnweave-"), "tarnweave.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("tarnweave", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)  # served by the driver; executors don't read its disk
    _shipped.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, run after the code has been given to the executors."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
