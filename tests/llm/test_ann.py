import numpy as np

from loomrecall.llm import ann as A


def brute(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    out = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out[ids[i]] = [ids[j] for j in order]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if y is None else float(y) for y in v], 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, b int, i int, v int")


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(0)
    centers = r.standard_normal((30, 24))
    x = (centers[r.integers(0, 30, 1500)] + 0.5 * r.standard_normal((1500, 24))).astype(np.float32)
    ids = list(range(1500))
    got = {}
    for q in A.nearest(table(spark, list(zip(ids, x))), k=10, bucket=32, every=1).collect():
        got.setdefault(q.query_id, []).append((q.rank, q.neighbor_id, q.cosine))
    want = brute(x.astype(float), ids, 10)
    hits = sum(len({n for _, n, _ in got.get(i, [])} & set(want[i])) for i in ids)
    assert hits >= 0.9 * 10 * len(ids)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for i in ids[:200]:
        for rank, n, c in got[i]:
            assert abs(c - u[i] @ u[n]) < 1e-6
        assert [g[0] for g in sorted(got[i])] == list(range(1, len(got[i]) + 1))


def test_groups_and_shards_find_the_same(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = r.standard_normal((600, 16)).astype(np.float32)
    rows = list(zip(range(600), x))
    a = {tuple(q) for q in A.nearest(table(spark, rows), k=5, bucket=32, every=1).collect()}
    monkeypatch.setattr(A, "SHARD", 40)
    b = {tuple(q) for q in A.nearest(table(spark, rows), k=5, bucket=32, every=1).collect()}
    assert a == b


def test_odd_vectors(spark):
    e = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, e), (2, e), (3, e), (3, e), (4, None), (5, []), (6, [0.0] * 4), (7, [1.0, None, 0.0, 0.0]), (8, [float("nan"), 0, 0, 1]), (9, [1.0, 2.0]), (None, e), (10, [float("inf"), 0, 0, 0])]
    got = sorted((q.query_id, q.rank, q.neighbor_id) for q in A.nearest(table(spark, rows), k=5, every=1).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]
    assert A.nearest(table(spark, [])).count() == 0
    assert A.nearest(table(spark, [(4, None)])).count() == 0


def test_queries_are_the_ids_divisible_by_fifty_against_all_rows(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((3000, 24)).astype(np.float32)
    ids = [int(i) for i in r.permutation(6000)[:3000] - 1000]
    df = table(spark, list(zip(ids, x))).repartition(3)
    found = A.nearest(df, bucket=16)
    got = {}
    for q in found.collect():
        got.setdefault(q.query_id, []).append(q.neighbor_id)
    want = {i: n for i, n in brute(x.astype(float), ids, 10).items() if i % 50 == 0}
    assert set(got) == set(want) and any(n % 50 for ns in got.values() for n in ns)
    hits = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hits >= 0.9 * 10 * len(want)
    assert abs(A.measured_recall(df, found) - hits / (10 * len(want))) < 0.005


def test_same_id_with_different_vectors_is_the_largest(spark):
    e, f = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, e), (1, f), (2, [0.9, 0.1, 0.0, 0.0]), (3, [0.1, 0.9, 0.0, 0.0])]
    got = {(q.query_id, q.rank): q.neighbor_id for q in A.nearest(table(spark, rows), k=1, every=1).collect()}
    assert got[(1, 1)] == 2 and got[(2, 1)] == 1


def test_hadamard_keeps_lengths_and_probes_start_with_the_code():
    r = np.random.default_rng(2)
    x = r.standard_normal((50, 32))
    assert np.allclose(np.linalg.norm(A.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    h = A.Hasher(32, 2, 4, 1)
    y = h.axes(x, 0)
    own = [int(np.argmax(np.concatenate([a, -a]))) * 8 + int(np.argmax(np.concatenate([b, -b]))) for a, b in zip(*y)]
    p = h.probes(x, 0, 10)
    assert p[:, 0].tolist() == own and all(len(set(row)) == 10 for row in p.tolist())


def test_probes_grow_where_codes_are_many(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((2000, 16)).astype(np.float32)
    hashes, last = A.plan(2000, 16, 4)
    assert hashes >= 2 and 32 ** (hashes - 1) * 2 * last > 50 * 4
    got = {}
    for q in A.nearest(table(spark, list(zip(range(2000), x))), k=10, tables=4, probes=4, bucket=4, every=1).collect():
        got.setdefault(q.query_id, set()).add(q.neighbor_id)
    want = brute(x.astype(float), list(range(2000)), 10)
    assert sum(len(got.get(i, set()) & set(want[i])) for i in want) >= 0.9 * 10 * 2000
