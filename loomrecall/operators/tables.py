"""Tables written to the shared folder, and row numbers without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a table that is broadcast; larger sides are shuffled.
BROADCAST_BYTES = 8 << 20
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the cluster names it. Where it is unset a temporary
    folder stands in, on a local master only: elsewhere executors would write to their own disks."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="loomrecall-")
    return _local[sc.applicationId]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there,
    and the loss of an executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only if rows * row_bytes, which the caller counted, is small."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def numbered(df: DataFrame, order: list[str], column: str) -> DataFrame:
    """df with ``column``: 1, 2, ... in the order of the named columns. Rows are range-
    partitioned and numbered within partitions; the counts of the partitions before, as many
    numbers as partitions, are added."""
    part, row = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    at = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    before, total = [], 0
    for p, n in sorted((r["p"], r["n"]) for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        before += [F.lit(p), F.lit(total).cast("long")]
        total += n
    if not total:
        return at.select(*df.columns, F.lit(0).cast("long").alias(column))
    return at.select(*df.columns, (F.element_at(F.create_map(*before), part) + row + 1).alias(column))
