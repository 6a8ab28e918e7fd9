"""Queue consumers as structured streams: deduplication, suppression, dead letters, upserts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnweave.operators.ordering import last_per_key
from tarnweave.operators.tables import upsert
from tarnweave.schemas import QUEUE_ITEM
from tarnweave.sources.io import names_in, remove, write_file


def read_messages(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """A stream of message bodies, one per line; ``max_files`` per batch is the back-pressure."""
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", max_files).text(path)


def decoded(messages: DataFrame) -> DataFrame:
    """Queue items with the raw message; an item that can't be decoded has a null url."""
    return messages.select("value", F.from_json("value", QUEUE_ITEM).alias("i")).select("value", "i.*")


def good_items(messages: DataFrame) -> DataFrame:
    return decoded(messages).where(F.col("url").isNotNull()).drop("value")


def dead_letters(messages: DataFrame) -> DataFrame:
    """Messages that hold no item; empty bodies are dropped without a trace."""
    return decoded(messages).where(F.col("url").isNull() & (F.trim("value") != "")).select("value")


def deduplicated(items: DataFrame, keys: list[str], event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Each key once over the life of the stream; with a watermark, state older than it is dropped."""
    if event_time and delay:
        return items.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    return items.dropDuplicates(keys)


def suppression(items: DataFrame, *, key: str, order: str, bad: str, threshold: int = 3) -> DataFrame:
    """Counts penalised rows per key in state; adds ``suppressed`` to rows after the threshold.

    Rows of one key in a batch are taken in the order of ``order``; state holds one number per key.
    """
    fields = [f for f in items.schema.fields if f.name in (key, order, bad)]
    out = T.StructType([*fields, T.StructField("suppressed", T.BooleanType())])
    names = [f.name for f in fields]

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for pdf in [pd.concat(list(batches))]:
            pdf = pdf.sort_values(order)[names]
            before = seen + pdf[bad].astype("int64").cumsum() - pdf[bad].astype("int64")
            seen = int(seen + pdf[bad].sum())
            state.update((seen,))
            yield pdf.assign(suppressed=(before >= threshold).to_numpy())

    return items.select(*names).groupBy(key).applyInPandasWithState(step, out, "seen long", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all that is there, then stops."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Parts of a table that is kept by upserts; a batch rewrites those that its keys fall into.
BUCKETS = 64


class UpsertSink:
    """foreachBatch sink that keeps the newest row per key in a table of BUCKETS parts.

    A batch reads and writes only the parts that its keys fall into, as files of version
    ``batch_id``, and then a manifest that says in which version each part is. It starts from
    the newest manifest before its own, so a repeated batch does the same again and
    at-least-once delivery gives exactly one result. Versions without any part in the last two
    manifests are deleted.
    """

    def __init__(self, root: str, keys: list[str], order: str):
        self.root, self.keys, self.order = root, keys, order

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = last_per_key(batch, self.keys, self.order).withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int")).persist()
        touched = sorted(r._bucket for r in fresh.select("_bucket").distinct().collect())  # BUCKETS at most
        before = [v for v in self._versions(spark) if v < batch_id]
        placed = self._manifest(spark, before[-1]) if before else {}
        old = self._read(spark, {b: placed[b] for b in touched if b in placed})
        merged = upsert(old, fresh.drop("_bucket"), self.keys, self.order) if old is not None else fresh.drop("_bucket")
        merged = merged.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int"))
        if touched:
            merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/v={batch_id}")
        fresh.unpersist()
        now = placed | dict.fromkeys(touched, batch_id)
        write_file(spark, f"{self.root}/manifest/{batch_id}.json", json.dumps(now))
        kept = set(now.values()) | set(placed.values()) | {batch_id}
        for v in before:
            if v not in kept:
                remove(spark, f"{self.root}/v={v}")

    def _versions(self, spark: SparkSession) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in names_in(spark, f"{self.root}/manifest") if n.endswith(".json"))

    def _manifest(self, spark: SparkSession, version: int) -> dict[int, int]:
        text = "".join(r.value for r in spark.read.text(f"{self.root}/manifest/{version}.json").collect())  # one line
        return {int(b): v for b, v in json.loads(text).items()}

    def _read(self, spark: SparkSession, placed: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.root}/v={v}/_bucket={b}" for b, v in sorted(placed.items())]
        return spark.read.parquet(*paths) if paths else None

    def latest(self, spark: SparkSession) -> DataFrame:
        """The table after the last whole batch."""
        versions = self._versions(spark)
        found = self._read(spark, self._manifest(spark, versions[-1])) if versions else None
        if found is None:
            raise ValueError(f"nothing was ever written to {self.root}")
        return found


def consume(stream: DataFrame, sink: UpsertSink, checkpoint: str) -> None:
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
