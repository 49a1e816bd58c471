"""Sums of arrays over all rows: matrix products inside the tasks, few numbers out of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 4096


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """An array column as a matrix, a row each. Arrays are of one length and hold no NULL."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def summed(data: DataFrame, size: int, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of ``part(batch)``, an array of ``size`` numbers; zeros for an empty table.

    A task holds one array, whatever it reads. There are no more of these than tasks that run at a time, so what is
    shuffled does not grow with the rows; chunks of them are added up in parallel, and ``size`` numbers reach the driver.
    """

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                v = part(b)
                total = v if total is None else total + v
        if total is not None:
            pieces = [total[i : i + CHUNK] for i in range(0, size, CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.list_(pa.float64()))], names=["chunk", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for c, v in zip(b.column("chunk").to_pylist(), b.column("v")):
                x = v.values.to_numpy(zero_copy_only=False)
                held[c] = held[c] + x if c in held else x
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["chunk", "v"])

    schema = "chunk int, v array<double>"
    parts = data.coalesce(data.sparkSession.sparkContext.defaultParallelism).mapInArrow(reduced, schema)
    out = np.zeros(size)
    for r in parts.repartition("chunk").mapInArrow(added, schema).collect():
        out[r["chunk"] * CHUNK :][: len(r["v"])] = r["v"]
    return out
