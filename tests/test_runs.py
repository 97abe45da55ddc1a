import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrecall.functions import domain, hashing
from loomrecall.operators import encoders, lexical
from loomrecall.plans import runs
from loomrecall.sources import synthetic
from loomrecall.sources.datasets import DatasetError


def test_sweep(spark):
    data = synthetic.text_corpus(spark, 50)
    for r in (runs.bm25_retriever, runs.bow_retriever):
        m = runs.run_retrieval_eval(data, r).metrics
        assert m["recall_10"] >= 0.5 and m["no_answer_accuracy"] == 1.0
    bad = data | {"qrels": data["qrels"].union(spark.createDataFrame([("q0", "gone", 1)], "a string, b string, c int"))}
    with pytest.raises(DatasetError, match="item unknown"):
        runs.run_retrieval_eval(bad, runs.bm25_retriever)
    with pytest.raises(ValueError):
        runs.Report("x", {"mrr": 1.5}, 1, 1, 1.0)
    assert runs.Report("x", {"mrr": 0.5}, 10, 1, 2.0).as_dict()["queries_per_second"] == 5


def test_grid(spark):
    d, q = synthetic.clustered_vectors(spark, 300, 20, 16)
    got = runs.rerank_grid(d, q, 16, ["random_hyperplane", "itq"], [16, 32], [1], [10, 300])
    assert len(got) == 6 and all(g["coverage"] == 1 for g in got if g["limit"] == 300)
    assert all(0 <= g["coverage"] <= 1 for g in got)


def test_sparse_encoding(spark):
    x = np.random.default_rng(0).standard_normal((20, 9)).astype(np.float32)
    x[x < 0.3] = 0
    e = encoders.hyperplane(9, 40)
    rows = [(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v]
    got = {r.id: r.words for r in encoders.encode_sparse(spark.createDataFrame(rows, "id long, dimension int, value double"), e).collect()}
    want = encoders.pack(e.flags(x))
    assert all(got[i] == want[i].tolist() for i in got)


def test_hashed_embedding_and_ids(spark):
    df = spark.createDataFrame([(1, "Alpha beta alpha"), (2, None)], "id long, text string").orderBy("id")
    v = [r.v for r in df.select(hashing.hashed_embedding(F.col("text"), 32).alias("v")).collect()]
    assert np.allclose(v[0], hashing.embed("alpha BETA alpha", 32)) and abs(np.linalg.norm(v[0]) - 1) < 1e-6 and not any(v[1])
    t = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["a", "c"])], "id long, terms array<string>")
    assert sorted(tuple(r) for r in lexical.token_ids(t).collect()) == [(1, "b", 1), (2, "a", 2), (3, "c", 1)]


def test_domain_rules(spark):
    df = spark.createDataFrame([("chunk", "c", None), ("chunk", "c", "k"), ("fact", None, "k"), (None, "c", None)], "kind string, c string, k string")
    assert [r[0] for r in df.select(domain.valid_record(F.col("kind"), F.col("c"), F.col("k"))).collect()] == [True, False, True, False]
    one = spark.range(1).select(
        domain.parse(F.lit(" Cosine"), domain.METRICS), domain.parse(F.lit("x"), domain.METRICS, "cosine"), domain.valid_message(F.lit("a"), F.lit("t"), F.lit("")),
        domain.valid_fact(F.lit("a"), F.lit("s"), F.lit("v")), domain.valid_object(F.lit("section"), F.lit("a"), F.lit("r"), F.lit(None)), domain.valid_posting(F.lit(2), F.array(F.lit(0), F.lit(5))),
    ).first()
    assert tuple(one) == ("cosine", "cosine", False, True, False, True)
    assert domain.table_name("t_", "a-b.é1") == "t_a_b__1"
