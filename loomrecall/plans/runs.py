"""Evaluation runs: validate a dataset, run a retriever over it, score and report; grids."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bow_tokens, standard_terms
from ..operators import binary, encoders, evaluation, lexical, vectors
from ..sources.datasets import DatasetError
from . import retrieval

Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]


def bm25_retriever(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return lexical.bm25(*_lexical(items, queries, standard_terms), k)


def bow_retriever(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return lexical.bow_cosine(*_lexical(items, queries, bow_tokens), k)


def overlap_retriever(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return lexical.keyword_overlap(*_lexical(items, queries, standard_terms), k)


def _lexical(items: DataFrame, queries: DataFrame, terms) -> tuple[DataFrame, DataFrame]:
    t = lexical.token_table(items, "item_id", terms(F.col("text")))
    return t, queries.select("query_id", terms(F.col("text")).alias("terms"))


def run_retriever(dataset: dict[str, DataFrame], retriever: Retriever, k: int = 50) -> DataFrame:
    """(query_id, item_id, rank) for all queries but ignored ones, in one job; each query's own limit holds."""
    asked = dataset["queries"].where(F.col("answer_mode") != evaluation.IGNORE)
    hits = retriever(dataset["items"], asked, k).withColumnRenamed("doc_id", "item_id")
    limits = asked.select("query_id", F.col("limit").alias("most"))
    return hits.join(limits, "query_id").where("rank <= most").select("query_id", "item_id", "rank")


@dataclass(frozen=True)
class Report:
    """Quality and speed of a run; checked when built."""

    name: str
    metrics: dict[str, float]
    queries: int
    items: int
    seconds: float
    schema_version: int = 1

    def __post_init__(self):
        if self.queries < 0 or self.items < 0 or not math.isfinite(self.seconds) or self.seconds < 0:
            raise ValueError("counts and times can't be negative")
        for k, v in self.metrics.items():
            if not math.isfinite(v) or (k != "judged" and not 0 <= v <= 1):
                raise ValueError(f"{k} must be a share")

    @property
    def queries_per_second(self) -> float:
        return self.queries / self.seconds if self.seconds else 0.0

    def as_dict(self) -> dict:
        return asdict(self) | {"queries_per_second": self.queries_per_second}


def run_retrieval_eval(dataset: dict[str, DataFrame], retriever: Retriever, name: str = "run", k: int = 50, recall_at=(1, 5, 10, 50), ndcg_at=(10,)) -> Report:
    """Validate, run, score. A dataset that breaks its contract raises."""
    broken = evaluation.violations(dataset["items"], dataset["queries"], dataset["qrels"]).limit(5).collect()
    if broken:
        raise DatasetError("; ".join(f"{r.rule}: {r.key}" for r in broken))
    start = time.time()
    m = evaluation.evaluate(dataset["queries"], dataset["qrels"], run_retriever(dataset, retriever, k), recall_at, ndcg_at).first()
    return Report(name, {c: float(v) for c, v in m.asDict().items()}, dataset["queries"].count(), dataset["items"].count(), time.time() - start)


FAMILIES = {
    "random_hyperplane": lambda v, d, b, s: encoders.hyperplane(d, b, s),
    "randomized_hadamard": lambda v, d, b, s: encoders.hadamard(d, b, s),
    "learned": lambda v, d, b, s: encoders.train_pair_difference(encoders.training_sample(v, s), b, s),
    "pca": lambda v, d, b, s: encoders.train_pca(encoders.training_sample(v, s), b, s),
    "itq": lambda v, d, b, s: encoders.train_itq(encoders.training_sample(v, s), b, s),
}


def rerank_grid(records: DataFrame, queries: DataFrame, dim: int, families: Iterable[str], bits: Iterable[int], seeds: Iterable[int], limits: Iterable[int], k: int = 10) -> list[dict]:
    """Coverage and first-hit agreement of Hamming candidates for each configuration.
    Projections to a subspace have no more bits than dimensions; others are left out."""
    exact = vectors.exact_topk(records, queries, k).persist()
    out = []
    limits = sorted(limits)
    for family, b, seed in product(families, bits, seeds):
        if family in ("pca", "itq") and b > dim:
            continue
        e = FAMILIES[family](records, dim, b, seed)
        d, q = (t.withColumn("words", encoders.encode(F.col("vector"), e)) for t in (records, queries))
        found = binary.hamming_topk(d, q, limits[-1]).persist()
        for limit in limits:
            c = retrieval.coverage(exact, found.where(F.col("rank") <= limit)).agg(F.avg("coverage"), F.avg("top1")).first()
            out.append({"family": family, "bits": b, "seed": seed, "limit": limit, "coverage": c[0], "top1": c[1]})
        found.unpersist()
    exact.unpersist()
    return out
