"""Keyed replacement and erasure over immutable tables: anti-join, then union."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """base with rows of delta in place of those with the same key; of several rows in delta
    the one with the largest ``order``, or the last in the table's own order, wins."""
    whole = F.struct(*[F.col(c) for c in delta.columns])
    last = F.monotonically_increasing_id() if order is None else F.col(order)
    delta = delta.select(F.col(key).alias("__k"), whole.alias("__r"), last.alias("__o")).groupBy("__k").agg(F.max_by("__r", "__o").alias("r")).select("r.*")
    return base.join(delta.select(key), key, "left_anti").select(*base.columns).unionByName(delta.select(*base.columns))


def erase(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti").select(*base.columns)


def erased_counts(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(key, erased): how many rows of base each given key takes away, 0 included."""
    n = base.groupBy(key).agg(F.count("*").alias("erased"))
    return keys.select(key).distinct().join(n, key, "left").select(key, F.coalesce("erased", F.lit(0)).alias("erased"))


def manifest(chunks: DataFrame, resource: str = "resource_id", chunk: str = "chunk_id") -> DataFrame:
    """(resource_id, kind, chunk_id, ordinal): one document record of a resource and, for each
    of its chunks, a chunk, an embedding and a vector record of the same ordinal."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(resource).orderBy(chunk)) - 1
    each = chunks.select(F.col(resource).alias("resource_id"), F.col(chunk).cast("string").alias("chunk_id"), n.alias("ordinal"))
    refs = each.withColumn("kind", F.explode(F.array(*map(F.lit, ("chunk", "embedding", "vector")))))
    head = each.select("resource_id").distinct().select("resource_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(0).alias("ordinal"), F.lit("document").alias("kind"))
    return refs.select("resource_id", "kind", "chunk_id", "ordinal").unionByName(head.select("resource_id", "kind", "chunk_id", "ordinal"))


def reindex(chunks: DataFrame, manifests: DataFrame, snapshot: DataFrame, resource: str = "resource_id", chunk: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(chunks, manifests) after the resources in snapshot were replaced: all chunks that the
    old manifests name go, also those that the snapshot no longer has."""
    touched = snapshot.select(F.col(resource).alias("resource_id")).distinct()
    old = manifests.join(touched, "resource_id", "left_semi").where("kind = 'chunk'").select(F.col("chunk_id").alias("__old")).distinct()
    kept = chunks.join(old, chunks[chunk].cast("string") == old["__old"], "left_anti").select(*chunks.columns)
    new = manifest(snapshot, resource, chunk)
    return kept.unionByName(snapshot.select(*chunks.columns)), manifests.join(touched, "resource_id", "left_anti").select(*new.columns).unionByName(new)


def unchanged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Resources whose content and pipeline hashes are the same in both (resource_id, content_hash, pipeline_config_hash)."""
    return new.join(old.select("resource_id", "content_hash", "pipeline_config_hash"), ["resource_id", "content_hash", "pipeline_config_hash"], "left_semi")


class KeyedStore:
    """A keyed table in a folder: changes are appended as parts, the newest part of a key counts.

    An upsert or erasure writes only its own rows; a part is visible once Spark's committer
    has marked it complete, so readers never see half of one. ``compact`` folds the parts
    into one. Parts are numbered, so there must be one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = spark.createDataFrame([], schema).schema
        self.stored = spark.createDataFrame([], f"{schema}, __part long, __order long, __gone boolean").schema

    def _parts(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [f.getPath() for f in fs.listStatus(root)]
        done = [p.getName() for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        every = sorted((int(n.split("-")[1]), n) for n in done if n.split("-")[0] in ("part", "base"))
        bases = [k for k, n in every if n.startswith("base")]
        return [n for k, n in every if n.startswith("part") and k > (bases or [-1])[-1] or n == f"base-{(bases or [-1])[-1]}"]

    def _append(self, rows: DataFrame, gone: bool) -> None:
        n = max([int(p.split("-")[1]) for p in self._parts()], default=-1) + 1
        columns = [rows[c] if c in rows.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.schema.names]
        rows.select(*columns, F.lit(n).cast("long").alias("__part"), F.monotonically_increasing_id().alias("__order"), F.lit(gone).alias("__gone")).write.parquet(f"{self.path}/part-{n}")

    def upsert(self, rows: DataFrame) -> None:
        self._append(rows, False)

    def erase(self, keys: DataFrame) -> DataFrame:
        """(key, erased): how many rows each given key took away."""
        from .tables import materialize

        counts = materialize(erased_counts(self.read(), keys, self.key), "erased")
        self._append(keys.select(self.key).distinct(), True)
        return counts

    def read(self) -> DataFrame:
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.stored).parquet(*(f"{self.path}/{p}" for p in parts))
        whole = F.struct(*self.stored.names)
        last = rows.groupBy(F.col(self.key).alias("__k")).agg(F.max_by(whole, F.struct("__part", "__order")).alias("r"))
        return last.where("not r.__gone").select(*(F.col(f"r.{c}").alias(c) for c in self.schema.names))

    def find(self, key) -> DataFrame:
        """The row of a key; the filter reaches the scan, since it is on the grouping column."""
        return self.read().where(F.col(self.key) == F.lit(key))

    def compact(self) -> None:
        parts = self._parts()
        if len(parts) > 1:
            n = max(int(p.split("-")[1]) for p in parts)
            rows = self.read().select(*self.schema.names, F.lit(n).cast("long").alias("__part"), F.lit(0).cast("long").alias("__order"), F.lit(False).alias("__gone"))
            rows.write.parquet(f"{self.path}/base-{n}")


def document_store(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, f"{path}/documents", "document_id string, resource_id string, title string, content_hash string", "document_id")


def chunk_store(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, f"{path}/chunks", "chunk_id string, document_id string, ordinal int, text string", "chunk_id")


def replace_document(documents: KeyedStore, chunks: KeyedStore, document: DataFrame, fresh: DataFrame) -> None:
    """Upsert documents with their chunk lists: chunks that the new lists no longer have go."""
    old = chunks.read().join(document.select("document_id"), "document_id", "left_semi")
    vanished = old.join(fresh.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id")
    chunks.erase(vanished)
    documents.upsert(document)
    chunks.upsert(fresh)


def list_chunks(chunks: KeyedStore, documents: DataFrame) -> DataFrame:
    """Chunks of the documents (document_id) in order of ordinal."""
    return chunks.read().join(documents.select("document_id").distinct(), "document_id", "left_semi").orderBy("document_id", "ordinal", "chunk_id")


def erase_with_manifest(chunks: DataFrame, manifests: DataFrame, resources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, manifests, told): everything that the manifests of the resources name is erased,
    and the manifests too; told: (resource_id, erased), false where there was no manifest."""
    asked = resources.select("resource_id").distinct()
    mine = manifests.join(asked, "resource_id", "left_semi")
    left = erase(chunks, mine.where("kind = 'chunk'").select("chunk_id"), "chunk_id")
    had = mine.select("resource_id").distinct().withColumn("erased", F.lit(True))
    return left, erase(manifests, asked, "resource_id"), asked.join(had, "resource_id", "left").select("resource_id", F.coalesce("erased", F.lit(False)).alias("erased"))
