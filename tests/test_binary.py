import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrecall.functions.vectors import hamming, sign_words
from loomrecall.operators import binary, encoders


def bits(x, n):
    return sum(int(v) << i for i, v in enumerate(x[:n]))


def test_hyperplane_golden():
    v = np.array([[1.0, -2.0, 0.5]], np.float32)
    assert bits(encoders.hyperplane(3, 16, 42).flags(v)[0], 16) == 0xE4FB
    assert bits(encoders.hyperplane(3, 8, 42).flags(v)[0], 8) == 0xFB
    assert bits(encoders.hyperplane(3, 16, 43).flags(v)[0], 16) == 0x637D


def test_hadamard_is_a_signed_rotation():
    e = encoders.hadamard(5, 20)
    x = np.random.default_rng(0).standard_normal((30, 5)).astype(np.float32)
    f = e.flags(x)
    assert f.shape == (30, 20) and (f != e.flags(-x)).mean() > 0.99
    assert (f[:, :8] == encoders.hadamard(5, 8).flags(x)).all()


@pytest.mark.parametrize("train", [encoders.train_pair_difference, encoders.train_pca, encoders.train_itq])
def test_trained_encoders(train):
    x = np.random.default_rng(1).standard_normal((400, 12)).astype(np.float32) * np.arange(1, 13)
    e = train(x, 8)
    assert (train(x, 8).rows == e.rows).all() and e.info == train(x, 8).info
    share = e.flags(x).mean(axis=0)
    assert (abs(share - 0.5) < 0.12).all()
    if train is not encoders.train_pair_difference:
        assert np.allclose(e.rows.astype(float) @ e.rows.T, np.eye(8), atol=1e-4)
        with pytest.raises(ValueError):
            train(x, 13)


def test_registry_and_identity():
    r = encoders.Registry()
    a, b = encoders.hyperplane(3, 8).info, encoders.hyperplane(4, 8).info
    r.add(a)
    r.add(a)
    r.add(b)
    assert len(r.all()) == 2
    a.require(a)
    with pytest.raises(ValueError):
        a.require(b)


@pytest.fixture(scope="module")
def signed(spark):
    x = np.random.default_rng(2).standard_normal((200, 70)).astype(np.float32)
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    return x > 0, df.select("id", sign_words(F.col("v"), 70).alias("words"))


def test_sign_words_and_udf_agree(spark, signed):
    flags, df = signed
    got = {r.id: r.words for r in df.collect()}
    assert all(got[i] == w.tolist() for i, w in enumerate(encoders.pack(flags)))
    v = spark.createDataFrame([(1, [1.0, -2.0, 0.5]), (2, None)], "id long, v array<float>")
    out = {r.id: r.w for r in v.select("id", encoders.encode(F.col("v"), encoders.hyperplane(3, 16)).alias("w")).collect()}
    assert out == {1: [0xE4FB], 2: None}


def test_hamming(spark, signed):
    flags, df = signed
    d = (flags[:, None] != flags[None]).sum(2)
    want = sorted((i, j, r + 1, int(d[i, j])) for i in range(200) for r, j in enumerate(sorted((j for j in range(200) if j != i), key=lambda j: (d[i, j], j))[:5]))
    assert sorted(tuple(r) for r in binary.hamming_topk(df, df, 5, drop_self=True).collect()) == want
    a = df.select(F.col("words").alias("a"), F.col("id").alias("i")).crossJoin(df.where("id = 0").select(F.col("words").alias("b")))
    assert all(r.h == d[r.i, 0] for r in a.select("i", hamming(F.col("a"), F.col("b")).alias("h")).collect())


@pytest.mark.parametrize("tables,width,radius,multiplier,least", [(8, 8, 1, 2, 8), (4, 8, 2, 4, 16), (2, 10, 0, 1, 1)])
def test_multiprobe(spark, signed, tables, width, radius, multiplier, least):
    flags, df = signed
    k, n = 5, 200
    src = [[(t * width + o) * 70 // (tables * width) for o in range(width)] for t in range(tables)]
    h = np.stack([(flags[:, None][:, :, s] != flags[None][:, :, s]).sum(2) for s in src])
    d = (flags[:, None] != flags[None]).sum(2)
    found, diag = binary.multiprobe(df, df, 70, k, tables, width, radius, multiplier, least)
    want, stats = [], []
    for q in range(n):
        target = min(n, max(least, k * multiplier))
        for r in range(radius + 1):
            cand = [j for j in range(n) if h[:, q, j].min() <= r]
            if len(cand) >= target:
                break
        want += [(q, j, x + 1, int(d[q, j])) for x, j in enumerate(sorted(cand, key=lambda j: (d[q, j], j))[:k])]
        spots = {0: 1, 1: 1 + width, 2: 1 + width + width * (width - 1) // 2}[r]
        stats.append((q, r, tables * spots, int((h[:, q] <= r).sum()), len(cand)))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert sorted(tuple(r) for r in diag.collect()) == stats
    with pytest.raises(ValueError):
        binary.multiprobe(df, df, 70, radius=3)


def test_aggregates(spark, signed):
    flags, df = signed
    rows = {r.object_id: r for r in binary.aggregate_signatures(df.select((F.col("id") % 7).alias("object_id"), "words"), 70, 0.6).collect()}
    for g in range(7):
        f = flags[g::7]
        c, n = f.sum(0), len(f)
        for name, want in (("any", c > 0), ("all", c == n), ("majority", c * 2 >= n), ("threshold", c >= 0.6 * n)):
            assert getattr(rows[g], f"{name}_words") == encoders.pack(want[None])[0].tolist()


def test_health_golden(spark):
    """Four four-bit signatures, two of them equal: duplicate rate 0.25, mean distance 14/6."""
    r = np.random.default_rng(0)
    f = np.array([[0, 0, 0, 0], [0, 0, 0, 0], [1, 1, 1, 0], [0, 1, 1, 1]], bool)
    df = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(encoders.pack(f))], "id long, words array<bigint>")
    h = binary.code_health(df, 4).first()
    assert h.duplicate_rate == 0.25 and h.largest_bucket == 2 and h.constant_bit_fraction == 0
    d = [(f[i] != f[j]).sum() for i in range(4) for j in range(i)]
    assert binary.mean_pair_hamming(df).first().mean_distance == pytest.approx(sum(d) / 6)
    big = r.random((150, 64)) > 0.5
    df = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(encoders.pack(big))], "id long, words array<bigint>")
    m = binary.mean_pair_hamming(df, 500).first()
    pairs = [(i, j) for i in range(150) for j in range(i + 1, 150)]
    assert m.pairs == 500 and m.mean_distance == pytest.approx(np.mean([(big[i] != big[j]).sum() for i, j in (pairs[o] for o in binary.pair_ordinals(150, 500))]))


def test_multiprobe_writes_no_pairs(spark):
    """Pairs that share a bucket are counted in their blocks; none is shuffled. A filter counts
    candidates only, by record or by pair."""
    x = np.random.default_rng(5).standard_normal((3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(encoders.pack(x > 0))], "id long, words array<bigint>").persist()
    top = spark.sparkContext._jsc.sc().statusStore()
    wrote = lambda: top.executorList(False).apply(0).totalShuffleWrite()
    df.count()
    before = wrote()
    rows = binary.multiprobe(df, df, 64)[1].collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10000)
    assert len(rows) == 3000 and sum(r.visited for r in rows) > 2_000_000 and wrote() - before < 4_000_000
    some = df.where("id % 2 = 0").select(F.col("id").alias("doc_id"))
    pairs = df.select(F.col("id").alias("query_id")).where("query_id < 40").crossJoin(some)
    few = df.where("id < 40")
    one, two = binary.multiprobe(df, few, 64, allowed=some), binary.multiprobe(df, few, 64, allowed=pairs)
    for a, b in zip(one, two):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert {r.doc_id % 2 for r in one[0].collect()} == {0}
