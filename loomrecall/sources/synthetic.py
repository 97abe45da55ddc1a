"""Seeded generators for tests and grids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

TOPICS = ("storage", "network", "compiler", "graphics", "audio", "scheduler")
FACETS = ("setup", "failure", "tuning", "design", "limits")


def _frame(spark: SparkSession, x: np.ndarray, first: int = 0) -> DataFrame:
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "id long, vector array<float>")


def unit_vectors(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return _frame(spark, x / np.linalg.norm(x, axis=1, keepdims=True))


def clustered_vectors(spark: SparkSession, n: int, queries: int, dim: int, seed: int = 42, spread: float = 0.28, query_spread: float = 0.18) -> tuple[DataFrame, DataFrame]:
    """Noisy copies of at most 64 unit centres: (records, queries)."""
    r = np.random.default_rng(seed)
    c = r.standard_normal((min(64, max(1, n)), dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)

    def draw(m: int, s: float) -> np.ndarray:
        x = c[r.integers(0, len(c), m)] + s * r.standard_normal((m, dim))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    return _frame(spark, draw(n, spread)), _frame(spark, draw(queries, query_spread), n)


def text_corpus(spark: SparkSession, n: int, seed: int = 42) -> dict[str, DataFrame]:
    """items, queries and qrels of topics and facets; every item has a word of its own, every
    seventh repeats a common one, every fifth query has no answer."""
    r = np.random.default_rng(seed)
    items, queries, qrels = [], [], []
    for i in range(n):
        topic, facet = TOPICS[i % len(TOPICS)], FACETS[r.integers(len(FACETS))]
        body = [topic, facet, f"uniq{i:04d}", *r.choice(["alpha", "beta", "gamma", "delta"], 5)] + ["common"] * 12 * (i % 7 == 0) + [topic] * 5 * (i % 11 == 0)
        items.append((f"d{i}", " ".join(body)))
        if i % 5 == 4:
            queries.append((f"q{i}", f"missing{i:04d}", 10, "NoAnswer"))
        else:
            queries.append((f"q{i}", f"uniq{i:04d} {facet}", 10, "JudgedRetrieval"))
            qrels.append((f"q{i}", f"d{i}", 3))
    return {
        "items": spark.createDataFrame(items, "item_id string, text string"),
        "queries": spark.createDataFrame(queries, "query_id string, text string, limit int, answer_mode string"),
        "qrels": spark.createDataFrame(qrels, "query_id string, item_id string, grade int"),
    }
