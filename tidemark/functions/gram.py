"""Sums of products of many columns, by blocks of a matrix and a tree of two levels."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a block, and groups that meet before the last sum. A task of the tree holds as many
#: blocks of 128 KB as there are input partitions to a group, or groups.
CELLS, GROUPS = 1 << 14, 256


def _cut(matrix: np.ndarray) -> list[np.ndarray]:
    """The upper triangle, row after row, in blocks."""
    flat = matrix[np.triu_indices(len(matrix))]
    return [flat[at : at + CELLS] for at in range(0, len(flat), CELLS)]


def gram(df: DataFrame, columns: Sequence[str], centres: Sequence[float]) -> np.ndarray:
    """Sums over all rows of the products of any two of (1, columns), each column less its centre.

    A missing value counts as its centre, so it adds nothing. Each task multiplies its
    batches and sends its triangle in blocks; no expression, job or group depends on the
    number of columns. The driver gets one matrix. Without rows all sums are 0.
    """
    middle, width = np.asarray(centres, float), len(columns) + 1
    frame = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], F.spark_partition_id().alias("_part"))

    def multiply(batches):
        total, part = np.zeros((width, width)), None
        for batch in batches:
            if batch.num_rows:
                part = batch.column(width - 1)[0].as_py()
                z = np.column_stack([np.ones(batch.num_rows), *[batch.column(i).to_numpy(zero_copy_only=False) for i in range(width - 1)]])
                z[:, 1:] -= middle
                z[np.isnan(z)] = 0.0
                total += z.T @ z
        if part is not None:
            blocks = _cut(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(blocks)), pa.int64()), pa.array([part % GROUPS] * len(blocks), pa.int64()), pa.array(blocks, pa.list_(pa.float64()))],
                names=["block", "part", "sums"],
            )

    def add(table):
        sums = np.zeros(len(table["sums"][0]))
        for chunk in table["sums"].chunks:
            sums += chunk.flatten().to_numpy().reshape(len(chunk), -1).sum(axis=0)
        return pa.table({"block": table["block"][:1], "part": table["part"][:1], "sums": pa.array([sums], pa.list_(pa.float64()))})

    schema = "block long, part long, sums array<double>"
    level = frame.mapInArrow(multiply, schema).groupBy("block", "part").applyInArrow(add, schema)
    found = level.groupBy("block").applyInArrow(add, schema).orderBy("block").toArrow()
    out = np.zeros((width, width))
    if found.num_rows:
        out[np.triu_indices(width)] = found["sums"].combine_chunks().flatten().to_numpy()
    return out + np.triu(out, 1).T
