import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrecall.operators import lexical, vectors
from loomrecall.plans import retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(0)
    docs = {i: r.choices("abcdefghijkl", k=r.randint(0, 30)) for i in range(80)}
    docs[80], docs[81] = list("zz"), list("zz")  # a tie
    asked = {0: ["a", "b", "a"], 1: ["z"], 2: ["nothing"], 3: [], 4: list("kl")}
    t = spark.createDataFrame([(i, w) for i, w in docs.items()], "id long, terms array<string>")
    q = spark.createDataFrame([(i, w) for i, w in asked.items()], "query_id long, terms array<string>")
    return docs, asked, t, q


def bm25(docs, asked, k1=1.5, b=0.75, k=10, allowed=None):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    out = []
    for q, terms in asked.items():
        scored = []
        for i, d in docs.items():
            tf = Counter(d)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(d) / avg)) for w in terms if w in tf)
            if s > 0 and (allowed is None or i in allowed):
                scored.append((-round(s, 9), i, s))
        out += [(q, i, r + 1, round(s, 6)) for r, (_, i, s) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bm25(spark, corpus):
    docs, asked, t, q = corpus
    assert rows(lexical.bm25(t, q)) == bm25(docs, asked)
    assert rows(lexical.bm25(t, q, 3, 0.9, 0.4)) == bm25(docs, asked, 0.9, 0.4, 3)
    some = spark.createDataFrame([(i,) for i in range(0, 82, 2)], "id long")
    assert rows(lexical.bm25(t, q, allowed=some)) == bm25(docs, asked, allowed=set(range(0, 82, 2)))
    with pytest.raises(ValueError):
        lexical.bm25(t, q, k1=0)


def test_overlap_and_bow(corpus):
    docs, asked, t, q = corpus
    want = []
    for i, terms in asked.items():
        s = sorted((-len(set(terms) & set(d)), k) for k, d in docs.items() if set(terms) & set(d))[:10]
        want += [(i, k, r + 1, -v) for r, (v, k) in enumerate(s)]
    assert rows(lexical.keyword_overlap(t, q)) == sorted(want)
    want = []
    vocabulary = {w for d in docs.values() for w in d}
    for i, terms in asked.items():
        c = Counter(w for w in terms if w in vocabulary)
        if not c:
            continue
        s = []
        for k, d in docs.items():
            tf = Counter(d)
            dot = sum(c[w] * tf[w] for w in c)
            s.append((-round(dot / math.sqrt(sum(v * v for v in c.values()) * sum(v * v for v in tf.values())), 9) if dot else 0.0, k))
        want += [(i, k, r + 1, round(-v, 6) + 0.0) for r, (v, k) in enumerate(sorted(s)[:10])]
    assert rows(lexical.bow_cosine(t, q)) == sorted(want)


def test_phrase_and_fusion(spark, corpus):
    docs, _, t, _ = corpus
    q = spark.createDataFrame([(0, list("ab")), (1, list("zz"))], "query_id long, terms array<string>")
    want = [(i, k, n) for i, p in ((0, "ab"), (1, "zz")) for k, d in docs.items() if (n := sum("".join(d[j : j + 2]) == p for j in range(len(d))))]
    assert rows(lexical.phrase_matches(t, q)) == sorted(want)
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(0, 2, 1)], "query_id long, doc_id long, rank int")
    assert rows(lexical.rrf([(a, 1.0), (b, 1.0)])) == [(0, 1, 2, round(1 / 61, 6)), (0, 2, 1, round(1 / 62 + 1 / 61, 6))]


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_exact_vectors(spark, metric):
    r = np.random.default_rng(0)
    x = r.standard_normal((300, 7)).astype(np.float32)
    x[5] = x[9]
    x[11] = 0
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, vector array<float>, grp int")
    y = x.astype(float)
    dot = y @ y.T
    n = np.sqrt((y**2).sum(1))
    s = {"dot_product": dot, "euclidean": -((y[:, None] - y[None]) ** 2).sum(2), "cosine": np.divide(dot, n[:, None] * n[None], out=np.zeros_like(dot), where=n[:, None] * n[None] > 0)}[metric]
    for group in (False, True):
        want = []
        for i in range(300):
            c = sorted((-round(s[i, j], 9), j) for j in range(300) if j != i and (not group or i % 3 == j % 3))[:4]
            want += [(i, j, k + 1) for k, (_, j) in enumerate(c)]
        got = vectors.exact_topk(df, df, 4, metric, same_group=group, drop_self=True)
        assert sorted((r.query_id, r.doc_id, r.rank) for r in got.collect()) == sorted(want)
    if metric == "cosine":
        assert not [r for r in vectors.exact_topk(df, df, 2, zero_query_empty=True).collect() if r.query_id == 11]
        assert vectors.exact_topk(df, df, 0).count() == 0
        with pytest.raises(ValueError):
            vectors.exact_topk(df, df, 1, "other")


def test_facade_filters_and_decay(spark):
    docs = spark.createDataFrame([(1, "agent recall"), (2, "Agent"), (3, "other")], "doc_id long, text string")
    tokens = lexical.token_table(docs, "doc_id", F.split("text", " "))
    q = spark.createDataFrame([(1, "Agent"), (2, "  "), (3, None)], "query_id long, text string")
    assert [(r.query_id, r.doc_id) for r in retrieval.retrieve(tokens, docs, q).collect()] == [(1, 2)]
    assert retrieval.retrieve(tokens, docs, q, k=0).count() == 0
    m = spark.sql("select map('a', '1', 'b', '2') m, array(named_struct('key', 'a', 'value', '1')) f, array(named_struct('key', 'c', 'value', '1')) g, cast(array() as array<struct<key:string,value:string>>) e")
    keep = m.select(*(retrieval.metadata_filter(F.col("m"), F.col(c)) for c in "fge")).first()
    assert tuple(keep) == (True, False, True)
    d = spark.range(1).select(*(retrieval.decay(F.lit(2.0), F.lit(5.0), 10.0, k) for k in ("exponential", "linear")), retrieval.decay(F.lit(2.0), F.lit(0.0), 10.0, "linear", F.lit(1.0), 0.5)).first()
    assert [round(v, 6) for v in d] == [round(2 * math.exp(-0.5), 6), 1.0, round(2 + 0.5 * math.log(2), 6)]
    long = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, "a"), (3, None)], "doc_id long, text string")
    c = retrieval.sliding_chunks(long, 10, 3).orderBy("doc_id", "chunk").collect()
    assert [(x.doc_id, x.chunk, x.text.split()[0], x.n_words) for x in c] == [(1, 0, "0", 10), (1, 1, "7", 10), (1, 2, "14", 10), (1, 3, "21", 4), (2, 0, "a", 1)]


def test_scan_ties_zeros_and_null_groups(spark):
    """Copies and zero vectors tie across tiles and go by id; a null group is no one's; huge and tiny
    vectors pass the single-precision sieve."""
    x = np.zeros((900, 4))
    x[::3] = [1, 2, 3, 4]
    x[1::3] = np.random.default_rng(1).standard_normal((300, 4)) * 10.0 ** np.random.default_rng(2).integers(-30, 30, (300, 1))
    df = spark.createDataFrame([(i, v.tolist(), None if i % 9 == 0 else i % 2) for i, v in enumerate(x)], "id long, vector array<double>, grp int")
    n = np.sqrt((x**2).sum(1))
    s = np.divide(x @ x.T, n[:, None] * n[None], out=np.zeros((900, 900)), where=n[:, None] * n[None] > 0)
    got = {}
    for r in vectors.exact_topk(df, df, 6).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.doc_id
    for i in range(900):
        assert [got[i][k] for k in range(1, 7)] == sorted(range(900), key=lambda j: (-round(s[i, j], 9), j))[:6]
    grouped = vectors.exact_topk(df, df, 3, same_group=True).collect()
    assert grouped and not {r.query_id for r in grouped} & set(range(0, 900, 9)) and all(r.query_id % 2 == r.doc_id % 2 for r in grouped)


def test_phrases_apart_agree_with_the_sql(spark, tmp_path):
    """Repeats side by side, overlapping and apart are counted as the query's SQL counts them."""
    import duckdb

    from loomrecall.plans import oracle, queries

    docs = [(1, "aa bb aa bb aa bb"), (2, "aa aa aa aa"), (3, "aa bb x1 aa bb"), (4, "bb aa"), (5, None)]
    asked = [(1, "aa bb"), (2, "aa aa"), (3, "aa"), (4, "-")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = rows(queries.queries()["phrase_search"](spark, str(tmp_path)))
    assert got == sorted(con.execute(oracle.SQL["phrase_search"]).fetchall()) and (1, 1, 2) in got


def test_scan_of_documents_agrees_with_the_join(spark, corpus, monkeypatch):
    """Documents scored where they lie give what the joins give, and shuffle no pairs of document and
    query; without room for the queries, and with ids that repeat, the joins do the work."""
    from loomrecall.operators import scan

    _, _, t, q = corpus
    t = t.unionByName(spark.createDataFrame([(99, []), (98, ["z"] * 5)], "id long, terms array<string>")).repartition(3)
    q = q.withColumn("k1", F.when(F.col("query_id") == 0, 0.9)).withColumn("b", F.when(F.col("query_id") == 0, 0.2))
    kind = F.when(F.col("term") == "a", "must").when(F.col("term") == "k", "must_not").otherwise("should")
    clauses = lexical.query_terms(q).select("query_id", "term", kind.alias("clause"))
    run = lambda: [rows(f) for f in (lexical.bm25(t, q), lexical.bm25(t, q, 3, allowed=t.where("id % 2 = 0").select("id")), lexical.keyword_overlap(t, q, 5), lexical.bow_cosine(t, q), lexical.boolean_matches(t, clauses))]
    assert scan.plan(t, lexical.query_terms(q)) is not None and scan.plan(t.union(t), lexical.query_terms(q)) is None
    scanned = run()
    monkeypatch.setattr(scan, "ROWS", 1)
    assert scan.plan(t, lexical.query_terms(q)) is None
    assert scanned == run() and all(scanned)


def test_term_spans_agree_with_positions(spark, corpus):
    """First and last positions as of the full lists, also where ids repeat; unique ids aren't shuffled."""
    _, _, t, _ = corpus
    for tokens in (t, t.unionByName(t.where("id < 5").select("id", F.reverse("terms").alias("terms")))):
        want = lexical.positional_postings(tokens).select("id", "term", "tf", F.element_at("positions", 1), F.element_at("positions", -1))
        assert rows(lexical.term_spans(tokens)) == rows(want)
    assert "Exchange" not in lexical.term_spans(t)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """documents and benchmark with runs of every kind, a null, blanks and copies; and their SQL engine."""
    import duckdb

    r = random.Random(7)
    words = "apple Apple.. don't e-mail camelCase HTTPServer v1.2. 123. 12 -5 --flag src/main.c C:\\x foo_bar a::b ::b 世界 naïve xAB x ... - :".split()
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 40))), "s", "en" if i % 2 else "de") for i in range(120)]
    docs += [(120, None, "s", "en"), (121, "", "s", "de"), (122, docs[5][1], "s", "en")]
    asked = [(i, " ".join(r.choices(words, k=5))) for i in range(12)]
    where = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{where}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{where}/{t}.parquet/*.parquet'")
    return where, con


def scanned_once(spark, odd_tables, monkeypatch, name):
    """Rows of a query that agree with its SQL; it must tokenise once, and no token lists in the JVM."""
    from loomrecall.operators import scan
    from loomrecall.plans import oracle, queries

    where, con = odd_tables
    found, plans = scan.found, []

    def seen(*args, **more):
        out = found(*args, **more)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(scan, "found", seen)
    df = queries.queries()[name](spark, where)
    cur = con.execute(oracle.SQL[name])
    got = rows(df.select(*(d[0] for d in cur.description)))
    assert got and got == sorted(cur.fetchall())
    assert len(plans) == 1 and "regexp" not in plans[0]
    return df


def test_fusion_tokenises_once(spark, odd_tables, monkeypatch):
    scanned_once(spark, odd_tables, monkeypatch, "rrf_fusion")


def test_bag_of_words_tokenises_once(spark, odd_tables, monkeypatch):
    scanned_once(spark, odd_tables, monkeypatch, "bow_cosine_topk")


def test_facade_tokenises_once_and_leaves_texts_where_they_are(spark, odd_tables, monkeypatch):
    """Hits are sent to the documents, whatever size Spark takes them for."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scanned_once(spark, odd_tables, monkeypatch, "retrieval_facade")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["bm25_per_query", "bm25_topk", "bm25_override", "bm25_filtered", "bm25_standard", "keyword_overlap_topk", "boolean_search", "request_cap"])
def test_searches_tokenise_once(spark, odd_tables, monkeypatch, name):
    scanned_once(spark, odd_tables, monkeypatch, name)
