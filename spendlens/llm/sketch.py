"""A count sketch of fixed size, built by tasks, summed in slices by tasks, and small enough to broadcast.

``counts[cells(hash)]`` is at least the number of times that a hash was added. The sketch holds ``1 << bits`` counters
whatever the data, so broadcasting it needs no size check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .wordhash import mix

BITS = 20
SLICES = 64


def cells(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - bits)).astype(np.int64)


class Counts:
    """A task's counters."""

    def __init__(self, bits: int = BITS):
        self.bits, self.counts = bits, np.zeros(1 << bits, dtype=np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        np.add.at(self.counts, cells(hashes, self.bits), np.uint32(1))

    def slices(self) -> list[tuple[int, bytes]]:
        """Number and counters of each slice, in the narrowest unsigned type that holds them."""
        out, width = [], (1 << self.bits) // SLICES
        for i in range(SLICES):
            part = self.counts[i * width:(i + 1) * width]
            if part.any():
                out.append((i, part.astype(np.min_scalar_type(int(part.max()))).tobytes()))
        return out


def total(slices: DataFrame, bits: int = BITS) -> np.ndarray:
    """The sum of the slices of all tasks (columns ``slice``, ``counts``), capped at 2^32 - 1; 4 bytes a counter come
    back at most.
    """
    width = (1 << bits) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = data.as_buffer()
                part = np.frombuffer(raw, dtype=f"u{len(raw) // width}").astype(np.int64)
                sums[i] = sums[i] + part if i in sums else part
        most = {i: np.minimum(s, 0xFFFFFFFF).astype(np.uint32) for i, s in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int32()),
                                          pa.array([s.tobytes() for s in most.values()], pa.binary())],
                                         names=["slice", "counts"])

    out = np.zeros(1 << bits, dtype=np.uint32)
    summed = slices.select("slice", "counts").repartition(SLICES, "slice").mapInArrow(run, "slice int, counts binary")
    for row in summed.collect():
        out[row["slice"] * width:(row["slice"] + 1) * width] = np.frombuffer(row["counts"], dtype=np.uint32)
    return out


def of_column(df: DataFrame, column: str) -> np.ndarray:
    """The sketch of a column of 64-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counts()
        for batch in batches:
            own.add(batch.column(0).to_numpy().view(np.uint64))
        part = own.slices()
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int32()),
                                          pa.array([c for _, c in part], pa.binary())], names=["slice", "counts"])

    return total(df.select(df[column].cast("long")).where(df[column].isNotNull())
                 .mapInArrow(run, "slice int, counts binary"))
