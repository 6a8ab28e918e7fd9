"""Hashed counters of a fixed size, summed over all partitions."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 16
SCHEMA = "chunk int, packed binary"


def packed(counts: np.ndarray) -> pa.RecordBatch:
    """One partition's counters as rows of ``SCHEMA``, without chunks of zeros; the length is a multiple of CHUNK."""
    parts = [(i, p) for i, p in enumerate(counts.reshape(-1, CHUNK)) if p.any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([zlib.compress(p.astype("<i8").tobytes(), 1) for _, p in parts], pa.binary())], names=["chunk", "packed"])


def summed(rows: DataFrame, size: int, kind: type = np.int64, shown: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The sum over all partitions; what reaches the driver is ``size`` counters, whatever the input.

    ``kind`` is that of the result. Sums are made in 64 bits; as float32 they keep seven digits. ``shown`` makes
    something smaller of the sums where they are, before they are sent.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, dtype=np.int64)
        for p in pdf["packed"]:
            total += np.frombuffer(zlib.decompress(p), dtype="<i8")
        sums = total.astype("<i8") if shown is None else shown(total)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "packed": [zlib.compress(sums.tobytes(), 1)]})

    out = np.zeros(size, dtype=kind)
    for r in rows.groupBy("chunk").applyInPandas(add, SCHEMA).collect():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(r.packed), dtype="<i8" if shown is None else kind)
    return out
