"""What the text operators share: staging in the shared folder, text columns, summing of model parts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.staging import shared_dir, shared_path, staged  # noqa: F401


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text column, null as empty: Python then neither decodes nor encodes what it needn't."""
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def arrow(columns: dict[str, tuple[list | np.ndarray | pa.Array, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in columns.values()], names=list(columns))


PART = 1 << 15


def parts(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A table of float64 as rows (part, data), for sum_parts."""
    flat = np.ascontiguousarray(table, dtype=np.float64).ravel()
    at = range(0, len(flat), PART)
    yield arrow({"part": ([i // PART for i in at], pa.int32()), "data": ([flat[i : i + PART].tobytes() for i in at], pa.binary())})


def sum_parts(made: DataFrame, size: int) -> np.ndarray:
    """Sum of the equally long tables that tasks made by parts(), in two steps: a task adds up about the root of the
    number of tables, one part after the other, and holds one sum for each part number. The driver gets the sum
    alone, size numbers."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(data)
                if k in sums:
                    sums[k] += x
                else:
                    sums[k] = x.copy()
        yield arrow({"part": (list(sums), pa.int32()), "data": ([x.tobytes() for x in sums.values()], pa.binary())})

    n = -(-size // PART)
    total = np.zeros(n * PART)
    groups = max(1, int(made.rdd.getNumPartitions() ** 0.5))
    some = made.withColumn("salt", F.spark_partition_id() % groups).repartition("part", "salt").select("part", "data").mapInArrow(add, "part int, data binary")
    for row in some.repartition(min(n, 16), "part").mapInArrow(add, "part int, data binary").collect():
        x = np.frombuffer(row["data"])
        total[row["part"] * PART : row["part"] * PART + len(x)] += x
    return total[:size]


class Memo(dict):
    """A bounded memo of a function of one argument: full, the younger half stays."""

    def __init__(self, f, most: int = 200_000):
        super().__init__()
        self.f, self.most, self.old = f, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.f(key)
        self[key] = value
        return value
