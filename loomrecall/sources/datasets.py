"""Retrieval datasets in JSON, report sinks and embedding checks."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILTERS = "array<struct<key:string,value:string>>"
DATASET = (
    "name string, corpus array<struct<id:string,title:string,text:string,metadata:map<string,string>>>, "
    f"queries array<struct<id:string,text:string,query_type:string,limit:bigint,metadata_filters:{_FILTERS},answer_mode:string>>, "
    "judgments array<struct<query_id:string,item_id:string,relevance_grade:int>>"
)
EMBEDDED = DATASET + (
    ", schema_version int, embedding_model struct<model_id:string,dimension:bigint,max_tokens:bigint,similarity_metric:string,"
    "pooling_mode:string,normalized:boolean>, document_embeddings array<struct<id:string,vector:array<float>>>, "
    "query_embeddings array<struct<id:string,vector:array<float>>>"
)


class DatasetError(ValueError):
    """A dataset breaks its contract; the message names the field."""


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def _require(root: DataFrame, fields: tuple[str, ...]) -> None:
    row = root.select(*(F.col(f).isNull().alias(f) for f in fields)).first()
    missing = [f for f in fields if row is None or row[f]]
    if missing:
        raise DatasetError(f"missing field {missing[0]}")


def read_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables items (item_id, title, text, metadata), queries (query_id, text, query_type,
    limit, filters, answer_mode) and qrels (query_id, item_id, grade) of a JSON dataset."""
    root = _read(spark, path, DATASET)
    _require(root, ("name", "corpus", "queries", "judgments"))
    return _tables(root)


def _tables(root: DataFrame) -> dict[str, DataFrame]:
    items = root.select(F.inline("corpus")).withColumnRenamed("id", "item_id")
    q = root.select(F.inline("queries")).select(
        F.col("id").alias("query_id"), "text", "query_type", "limit", F.coalesce("metadata_filters", F.expr(f"cast(array() as {_FILTERS})")).alias("filters"),
        F.coalesce("answer_mode", F.lit("JudgedRetrieval")).alias("answer_mode"),
    )
    qrels = root.select(F.inline("judgments")).withColumnRenamed("relevance_grade", "grade")
    return {"items": items, "queries": q, "qrels": qrels}


def read_embedded_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """As read_dataset, with document_vectors and query_vectors (id, vector) and model."""
    root = _read(spark, path, EMBEDDED)
    _require(root, ("name", "corpus", "queries", "judgments", "schema_version", "embedding_model", "document_embeddings", "query_embeddings"))
    if root.select("schema_version").first()[0] != 1:
        raise DatasetError("schema_version must be 1")
    return _tables(root) | {
        "model": root.select("embedding_model.*"),
        "document_vectors": root.select(F.inline("document_embeddings")),
        "query_vectors": root.select(F.inline("query_embeddings")),
    }


def embedding_problems(ids: DataFrame, vectors: DataFrame, dim: int, normalized: bool = True, tolerance: float = 1e-3) -> DataFrame:
    """(problem, id): vectors missing, unknown, repeated, of another length, not finite or not of unit length."""
    named = lambda df, p: df.select(F.lit(p).alias("problem"), "id")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    parts = [
        named(ids.join(vectors, "id", "left_anti"), "missing"),
        named(vectors.join(ids, "id", "left_anti"), "unknown"),
        named(vectors.groupBy("id").count().where("count > 1"), "repeated"),
        named(vectors.where(F.coalesce(F.size("vector"), F.lit(-1)) != dim), "dimension"),
        named(vectors.where(~finite), "not finite"),
    ]
    if normalized:
        parts.append(named(vectors.where(finite & (F.abs(norm - 1) > tolerance)), "not normalized"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def row_digests(vectors: DataFrame) -> DataFrame:
    """(id, sha256) of each vector's little-endian float32 bytes, in one Arrow pass."""
    @F.pandas_udf("string")
    def digest(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else hashlib.sha256(np.asarray(x, "<f4").tobytes()).hexdigest())

    return vectors.select("id", digest("vector").alias("sha256"))


def write_report(metrics: DataFrame, path: str, **sections) -> None:
    """One-row metrics as a JSON report file, with constant sections beside them."""
    report = json.loads(metrics.toJSON().first())
    body = json.dumps({"schema_version": 1, "quality": report} | sections, sort_keys=True)
    metrics.sparkSession.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_tables(path: str, items: DataFrame, queries: DataFrame, qrels: DataFrame) -> None:
    """A dataset of any size as JSON lines, one folder a table."""
    for name, df in (("items", items), ("queries", queries), ("qrels", qrels)):
        df.write.json(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a dataset written as JSON lines; a line that doesn't fit is an error."""
    schemas = {
        "items": "item_id string, title string, text string, metadata map<string,string>",
        "queries": f"query_id string, text string, query_type string, limit long, filters {_FILTERS}, answer_mode string",
        "qrels": "query_id string, item_id string, grade long",
    }
    t = {n: spark.read.schema(s).option("mode", "FAILFAST").json(f"{path}/{n}") for n, s in schemas.items()}
    q = t["queries"].withColumn("filters", F.coalesce("filters", F.expr(f"cast(array() as {_FILTERS})")))
    return t | {"queries": q.withColumn("answer_mode", F.coalesce("answer_mode", F.lit("JudgedRetrieval")))}


def write_text_report(metrics: DataFrame, path: str, title: str) -> None:
    """One-row metrics as a text report: a title, then a line for each figure."""
    row = metrics.first().asDict()
    lines = [title, "=" * len(title), *(f"{k}: {v}" for k, v in sorted(row.items()))]
    metrics.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
