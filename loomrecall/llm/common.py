"""Table access, shared-folder tables and batch slicing for the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import BROADCAST_BYTES, bounded_broadcast, materialize, shared_dir
__all__ = ["BROADCAST_BYTES", "bounded_broadcast", "log2_parts", "materialize", "pick", "record_batch", "shared_dir", "slices", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns under private names, so clashing extra columns can't interfere."""
    return df.select(*(df[c].alias(a) for a, c in columns.items()))


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``limit`` bytes in ``column`` (one row at least);
    a column of numbers holds sizes itself."""
    if batch.num_rows == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(np.asarray((col if pa.types.is_integer(col.type) else pa.compute.binary_length(col)).fill_null(0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def log2_parts(rows: int, target: int, most: int = 24) -> int:
    """Bits by which rows split into parts of about target rows."""
    return min(most, max(0, int(np.ceil(np.log2(max(rows, 1) / target)))))


def record_batch(schema: pa.Schema, arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, schema)], schema=schema
    )
