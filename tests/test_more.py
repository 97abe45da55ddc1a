"""Stores, aggregates, filters and checks that the queries' SQL doesn't reach."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from loomrecall.functions import hashing
from loomrecall.operators import binary, evaluation, lexical, store, tables, vectors
from loomrecall.plans import retrieval


def vec(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>")


def test_bad_vectors_are_errors(spark):
    good = vec(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    for bad in ([(3, None)], [(3, [1.0])], [(3, [])], [(3, [float("nan"), 1.0])], [(3, [1.0, None])]):
        with pytest.raises(Exception, match="vector"):
            vectors.exact_topk(good.union(vec(spark, bad)), good).collect()
    with pytest.raises(Exception, match="no vector for query 1, record 9"):
        vectors.rerank(spark.createDataFrame([(1, 9)], "query_id long, doc_id long"), good, good).collect()
    got = vectors.rerank(spark.createDataFrame([(1, 2), (1, 1)], "query_id long, doc_id long"), good, good, metric="euclidean").collect()
    assert [(r.doc_id, r.score) for r in got] == [(1, 0.0), (2, -2.0)]


def test_upsert_takes_the_last_of_a_key(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    delta = spark.createDataFrame([(2, "x"), (3, "y"), (2, "z")], "k long, v string").coalesce(1)
    assert sorted(map(tuple, store.upsert(base, delta, "k").collect())) == [(1, "a"), (2, "z"), (3, "y")]


def test_keyed_store(spark, tmp_path):
    s = store.KeyedStore(spark, str(tmp_path / "s"), "k string, v int", "k")
    rows = lambda *r: spark.createDataFrame(r, "k string, v int").coalesce(1)
    assert s.read().count() == 0
    s.upsert(rows(("a", 1), ("b", 2), ("a", 3)))
    assert s.find("a").first().v == 3 and s.find("z").count() == 0
    told = s.erase(spark.createDataFrame([("b",), ("z",)], "k string"))
    assert sorted(map(tuple, told.collect())) == [("b", 1), ("z", 0)]
    s.upsert(rows(("c", 4)))
    (tmp_path / "s" / "part-9").mkdir()  # never completed: unseen
    for _ in range(2):
        assert sorted(map(tuple, s.read().collect())) == [("a", 3), ("c", 4)]
        s.compact()
    s.upsert(rows(("b", 5)))
    assert sorted(map(tuple, s.read().collect())) == [("a", 3), ("b", 5), ("c", 4)]


def test_documents_and_their_chunks(spark, tmp_path):
    d, c = store.document_store(spark, str(tmp_path)), store.chunk_store(spark, str(tmp_path))
    doc = spark.createDataFrame([("d", "r", "t", "h")], "document_id string, resource_id string, title string, content_hash string")
    rows = lambda *r: spark.createDataFrame([(i, "d", n, i) for i, n in r], "chunk_id string, document_id string, ordinal int, text string")
    store.replace_document(d, c, doc, rows(("x", 2), ("y", 1), ("z", 0)))
    assert [r.chunk_id for r in store.list_chunks(c, doc).collect()] == ["z", "y", "x"]
    store.replace_document(d, c, doc, rows(("y", 0), ("w", 1)))
    assert [r.chunk_id for r in store.list_chunks(c, d.read()).collect()] == ["y", "w"]


def test_aggregate_underflow_and_emptied(spark):
    chunks = spark.createDataFrame([(1, [5]), (1, [1])], "object_id long, words array<long>")
    one = spark.createDataFrame([(1, [4])], "object_id long, words array<long>")
    of = lambda df: binary.bit_counts(df, 8)
    none = of(chunks.limit(0))
    empty = binary.signature_of_counts(binary.change_counts(of(chunks), none, of(chunks)), 8, "all").first()
    assert (empty.n, empty.words) == (0, [0])
    with pytest.raises(Exception, match="underflow"):
        binary.change_counts(of(one), none, of(chunks)).collect()
    with pytest.raises(ValueError):
        binary.signature_of_counts(none, 8, "threshold", 0.0)


def test_numbering_and_shared_tables(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x")).repartition(5)
    got = sorted((r.x, r.n) for r in tables.numbered(df, ["x"], "n").collect())
    assert got == [(x, x + 1) for x in range(5000)]
    assert tables.numbered(df.limit(0), ["x"], "n").count() == 0


def test_hashed_embedding_by_hand(spark):
    found = {"tok:abcd": 2, "tri:abc": 2, "tri:bcd": 2, "bigram:abcd_x": 1, "bigram:x_abcd": 1, "tok:x": 1}
    v = [0.0] * 32
    for f, n in found.items():
        h = hashlib.sha256(f"external-hash-embedding-32d-v1|{f}".encode()).digest()
        v[(h[0] | h[1] << 8 | h[2] << 16 | h[3] << 24) % 32] += (-1) ** (h[4] % 2) * (1 + math.log(n))
    size = sum(x * x for x in v) ** 0.5
    df = spark.createDataFrame([("Abcd, x abcd!",), (None,)], "t string")
    got = [r.e for r in df.select(hashing.hashed_embedding(F.col("t")).alias("e")).collect()]
    assert all(abs(a - b / size) < 1e-12 for a, b in zip(got[0], v)) and got[1] == [0.0] * 32
    with pytest.raises(Exception, match="the model gave 1 vectors"):
        df.coalesce(1).select(hashing.embedding(F.col("t"), lambda t: [[1.0]])).collect()
    assert hashing.fnv1a(b"") == 0xCBF29CE484222325 and hashing.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_fuzzy_by_brute_force(spark):
    words = ["cat", "cart", "car", "dog", "cta", "bat", "a", "ab", "caat"]
    v = spark.createDataFrame([(w,) for w in words], "term string")
    q = spark.createDataFrame([(1, ["cat", "b"]), (2, [])], "query_id long, terms array<string>")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for edits in (1, 2):
        got = {(r.term, r.match, r.distance) for r in lexical.fuzzy_terms(v, q, edits).collect()}
        assert got == {(t, w, lev(t, w)) for t in ("cat", "b") for w in words if lev(t, w) <= edits}


def test_filters_of_odd_values(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (None, None), (5, []), (9, ["b"])], "x long, t array<string>")
    run = lambda c: [bool(r[0]) for r in df.select(c).collect()]
    assert run(retrieval.in_range(F.col("x"), 1, 9)) == [True, False, True, False]
    assert run(retrieval.has_tags(F.col("t"), ["a", "b"])) == [True, False, False, False]
    assert run(retrieval.has_tags(F.col("t"), ["a", "b"], every=False)) == [True, False, False, True]
    assert run(retrieval.any_of(F.col("x") > 5, F.col("x") == 1)) == [True, False, False, True]


def test_run_breaches(spark):
    q = spark.createDataFrame([("q",)], "query_id string")
    rows = [("q", "a", 1, 1.0), ("q", "b", 1, float("nan")), ("q", "", None, 0.5), ("x", "c", 0, 1.0)]
    got = {tuple(r) for r in evaluation.run_violations(q, spark.createDataFrame(rows, "query_id string, item_id string, rank int, score double")).collect()}
    assert got == {("query unknown", "x"), ("item id empty", "q"), ("rank not positive", "x/c"), ("rank repeated", "q/1"), ("ranks mixed with none", "q"), ("score not finite", "q/b")}
