"""Summing small arrays over a distributed table: one pass per step of an iterative fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.session import ship_code

_PARTIAL = "slot int, sums array<double>"


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A scalar column of an Arrow batch."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An array column of equally long, complete arrays as one row-major matrix."""
    arrays = batch.column(batch.schema.get_field_index(name))
    return arrays.flatten().to_numpy(zero_copy_only=False).reshape(len(arrays), -1)


def summed_arrays(
    df: DataFrame, partitions: int, work: Callable[[pa.RecordBatch], dict[int, np.ndarray]]
) -> dict[int, np.ndarray]:
    """Apply ``work`` to every Arrow batch and sum its arrays per slot over the whole table.

    A task adds its batches up before it emits one row per slot, and the rows of a slot are added
    on the executors, so what reaches the driver depends on the model size and not on the data.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for slot, values in work(batch).items():
                    total[slot] = total[slot] + values if slot in total else values
        if total:
            yield pa.RecordBatch.from_pydict(
                {
                    "slot": pa.array(list(total), pa.int32()),
                    "sums": pa.array([v.ravel() for v in total.values()], pa.list_(pa.float64())),
                }
            )

    ship_code(df.sparkSession)
    partial = df.mapInArrow(task, _PARTIAL)
    merged = partial.groupBy("slot").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    rows = merged.select("slot", vector_to_array(F.col("sums")).alias("sums")).collect()
    return {slot: np.asarray(sums) for slot, sums in rows}
