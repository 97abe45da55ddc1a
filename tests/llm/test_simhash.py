import random

import numpy as np
import pyarrow as pa

from loomrecall.llm import simhash as H

from .kit import ODD, docs, words


def corpus():
    r = random.Random(2)
    rows, group = [], {}
    for d in range(300):
        rows.append((d, " ".join(words(150, d, length=8))))
        group[d] = d
    at = 300
    for d in range(0, 300, 3):
        for _ in range(r.randint(1, 4)):
            w = rows[d][1].split()
            for k in r.sample(range(len(w)), r.randint(0, 8)):
                w[k] = r.choice(w) + "q"
            rows.append((at, " ".join(w)))
            group[at] = d
            at += 1
    r.shuffle(rows)
    return rows, group


def test_groups_match_planted_and_brute_force(spark):
    rows, group = corpus()
    df = docs(spark, rows + ODD)
    got = {r.doc_id: r.kept_doc_id for r in H.near_duplicates(df).collect()}
    copies = {d: g for d, g in group.items() if d != g}
    assert sum(got.get(d) == g for d, g in copies.items()) >= 0.95 * len(copies)
    assert all(group[d] == group[k] for d, k in got.items())
    # brute force over descriptions: pairs within the radius that verify
    no, sig, sk = H.describe(pa.array([t for _, t in rows]))
    a, b = np.nonzero(np.triu(H.gaps(sig[:, None], sig[None, :]) <= H.RADIUS, 1))
    ok = H.jaccard(sk[a], sk[b]) >= H.LEAST_JACCARD
    root = H._stars(len(rows), a[ok], b[ok])
    want = {}
    for i in range(len(rows)):
        want.setdefault(root[i], []).append(rows[no[i]][0])
    want = {d: min(m) for m in want.values() for d in m if d != min(m)}
    assert sum(got.get(d) == k for d, k in want.items()) >= 0.95 * len(want)
    kept = H.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows + ODD if r[0] not in got)


def graph_pairs(sig):
    return [(a, b) for q, m in H.Graph(sig).build(H.BEAM, H.RADIUS) for a, b in zip(q.tolist(), m.tolist())]


def test_graph_recall():
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 63, (1500, 2), dtype=np.uint64)
    near = base.copy()
    for _ in range(12):
        near[np.arange(1500), r.integers(0, 2, 1500)] ^= np.uint64(1) << r.integers(0, 63, 1500).astype(np.uint64)
    sig = np.concatenate([base, near])[r.permutation(3000)]
    want = {p for p in zip(*(x.tolist() for x in H._exact(sig, sig, H.RADIUS))) if p[0] > p[1]}
    got = set(graph_pairs(sig))
    assert got <= want and len(got) >= 0.9 * len(want)


def test_beams_expand_over_large_groups():
    r = np.random.default_rng(1)
    center = r.integers(0, 1 << 63, (1, 2), dtype=np.uint64)
    tight = np.repeat(center, 400, axis=0)
    tight[:, 0] ^= np.uint64(1) << r.integers(0, 63, 400).astype(np.uint64)
    sig = np.concatenate([tight, r.integers(0, 1 << 63, (600, 2), dtype=np.uint64)])
    pairs = graph_pairs(sig)
    want = (len(H._exact(sig, sig, H.RADIUS)[0]) - 1000) / 2
    assert len(pairs) == len(set(pairs)) >= 0.9 * want


def test_routes_and_shards(spark, monkeypatch):
    rows, group = corpus()
    monkeypatch.setattr(H, "SHARD_ROWS", 64)
    got = {r.doc_id: r.kept_doc_id for r in H.near_duplicates(docs(spark, rows)).collect()}
    copies = {d: g for d, g in group.items() if d != g}
    assert sum(got.get(d) == g for d, g in copies.items()) >= 0.9 * len(copies)
    assert all(group[d] == group[k] for d, k in got.items())


def test_many_copies_ties_and_empty(spark):
    rows = [(d, "the same short text of every row") for d in range(500, 0, -1)] + [(500, "the same short text of every row")]
    got = H.near_duplicates(docs(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(2, 501)) and {r.kept_doc_id for r in got} == {1}
    assert H.near_duplicates(docs(spark, [])).count() == 0
    assert H.near_duplicates(docs(spark, ODD)).count() == 0
    assert H.drop_near_duplicates(docs(spark, ODD)).count() == len(ODD)


def test_components_by_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(parent) if find(x) != x}
    got = {x.i: x.root for x in H.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def brute_links(reps):
    """Verified pairs of (id, signature, sketch) by an exact scan."""
    ids, sig, sk = (np.array(x) for x in zip(*reps))
    a, b = np.nonzero(np.tril(H.gaps(sig[:, None], sig[None, :]) <= H.RADIUS, -1))
    ok = (H.jaccard(sk[a], sk[b]) >= H.LEAST_JACCARD) & (ids[a] != ids[b])
    return {(max(x, y), min(x, y)) for x, y in zip(ids[a[ok]].tolist(), ids[b[ok]].tolist())}


def planted(n, seed=3):
    """Signatures at the radius and sketches just above the least similarity."""
    r = np.random.default_rng(seed)
    bits = r.integers(0, 2, (n, 128), dtype=np.uint8)
    near = bits.copy()
    for row in near:
        row[r.choice(128, H.RADIUS, replace=False)] ^= 1
    sig = np.packbits(np.concatenate([bits, near]), axis=1, bitorder="little").view(np.uint64)
    first = r.integers(0, 1 << 15, (n, H.BINS)).astype(np.uint16)
    second = first.copy()
    for row in second:
        row[r.choice(128, 128 - 84, replace=False)] ^= 1 << 15  # 84 of 128 bins agree: 0.656
    return sig, np.concatenate([first, second])


def frame(spark, sig, sk):
    rows = [(i, *(int(x) for x in s.view(np.int64)), bytearray(k.tobytes())) for i, (s, k) in enumerate(zip(sig, sk))]
    return spark.createDataFrame(rows, "i long, s0 long, s1 long, sketch binary")


def test_least_similar_pairs_meet_whatever_the_bins(spark, monkeypatch):
    n = 1500
    sig, sk = planted(n)
    reps = frame(spark, sig, sk)
    for shard in (8192, 2):  # one bin a band, and several
        monkeypatch.setattr(H, "SHARD_ROWS", shard)
        got = {(e.u, e.v) for e in H.found_in_shards(reps, 2 * n).where("kind = 'edge'").collect()}
        assert got <= {(i + n, i) for i in range(n)}
        assert len(got) >= 0.9 * n


def test_bands_grow_with_their_bins():
    sig, sk = planted(4000, 4)
    v = H.dense(sk)
    for bins in range(1, 7):
        met = np.zeros(4000, bool)
        for t in range(H.routes_for(bins)):
            b = list(H.band(t, bins))
            met |= (v[:4000][:, b] == v[4000:][:, b]).all(axis=1)
        assert met.mean() >= 0.93
    assert len({H.band(t, 5) for t in range(60)}) == 60


def test_hot_shards_are_banded_again_and_cut_without_loss(spark, monkeypatch):
    """All rows share the first bins; edges and links against an exact scan."""
    sig, sk = planted(700, 5)
    sk[:, list(H.band(0, 1) + H.band(1, 1) + H.band(2, 1))] = 7
    want = brute_links(list(zip(range(1400), sig, sk)))
    assert len(want) == 700
    for hot, shard in ((1 << 18, 100), (300, 8192), (300, 20)):
        monkeypatch.setattr(H, "HOT_ROWS", hot)
        monkeypatch.setattr(H, "SHARD_ROWS", shard)
        monkeypatch.setattr(H, "mean_shards", lambda reps, most: [1.0])
        found = H.found_in_shards(frame(spark, sig, sk), 1400).collect()
        edges = {(e.u, e.v) for e in found if e.kind == "edge"}
        assert edges <= want and len(edges) >= 0.9 * len(want)
        links = {}
        for e in found:
            if e.kind == "link":
                links[e.u] = links.get(e.u, 0) + e.v
        assert all(links[i] == 1 for e in edges for i in e) if hot > 1000 else sum(links.values()) <= 2 * len(want)


def test_links_count_each_partner_once(spark):
    rows, _ = corpus()
    reps, members, _ = H.represented(docs(spark, rows))
    made = reps.collect()
    pairs = brute_links([(r.i, np.array([r.s0, r.s1], np.int64).view(np.uint64), np.frombuffer(r.sketch, np.uint16)) for r in made])
    want = {}
    for p in pairs:
        for i in p:
            want[i] = want.get(i, 0) + 1
    got = {r.doc_id: r.links for r in H.near_duplicates(docs(spark, rows)).collect()}
    rep = {r.i: r.rep for r in members.collect()}
    assert got and sum(n == want.get(rep[d], 0) for d, n in got.items()) >= 0.95 * len(got)
    assert all(n <= want.get(rep[d], 0) for d, n in got.items())
    wanted, kept = H.measured_recall(docs(spark, rows), 100)
    assert wanted and kept >= 0.95 * wanted


def test_empty_bins_and_small_shards():
    sk = np.full((3, 128), 0xFFFF, np.uint16)
    sk[0, 5], sk[1, 5], sk[2, [5, 90]] = 9, 9, (9, 4)
    v = H.dense(sk)
    assert (v[0] == v[1]).all() and (v[2, 6:91] == (4 << 8 | 90)).all() and (v[2, 91:] == (9 << 8 | 5)).all()
    r = np.random.default_rng(0)
    sig, sk = planted(200, 6)
    shard = np.sort(r.integers(0, 30, 400))
    found = H.small_shards(sig, np.arange(400), sk, shard, [])
    want = {(a, b) for a, b in brute_links(list(zip(range(400), sig, sk))) if shard[a] == shard[b]}
    u, v, _, n = found.result()
    assert set(zip(u.tolist(), v.tolist())) == want and n.sum() == 2 * len(want)


def test_several_texts_of_one_id_and_very_long_texts(spark):
    a, b = " ".join(words(200, 1, length=8)), " ".join(words(200, 2, length=8))
    long = " ".join(words(150_000, 3, length=9))
    got = {r.doc_id: r.kept_doc_id for r in H.near_duplicates(docs(spark, [(3, a), (7, b), (7, a), (9, b), (5, long), (6, long + " end")])).collect()}
    assert got == {7: 3, 9: 3, 6: 5}
