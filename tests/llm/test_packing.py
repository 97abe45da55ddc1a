import random

import numpy as np
import pyarrow as pa

from loomrecall.llm import packing as P
from loomrecall.llm.textkit import mix64, words_of

from .kit import ODD, docs, words


def test_hilbert_is_a_curve():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    k = P.hilbert(g, 3)
    assert sorted(k) == list(range(512))
    assert (np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(axis=1) == 1).all()


def slow_key(text):
    """Hilbert key of a text, one word and one cell at a time: the cell is sought by halving the cube."""
    import re

    v = [0.0] * P.DIM
    for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text):
        h = int(mix64(words_of(pa.array([w]), alnum=True).hashes() + np.uint64(3))[0])
        v[h % P.DIM] += 1 if h >> 63 else -1
    size = max(sum(x * x for x in v) ** 0.5, 1e-12)
    m = P._projection()
    grid = [min(max(int((sum(x / size * m[i][a] for i, x in enumerate(v)) + 2) / 4 * (1 << P.BITS)), 0), (1 << P.BITS) - 1) for a in range(P.AXES)]
    return grid


def slow_pack(ps, limit):
    """Best fit in curve order, stated anew: sequences are lists of pieces."""
    seqs, open_ = [], []
    for key, i, n in ps:
        at = 0
        while n - at >= limit:
            seqs.append([(i, at, limit, key)])
            at += limit
        if n > at:
            used = {s: sum(p[2] for p in seqs[s]) for s in open_}
            fits = [s for s in open_ if used[s] + n - at <= limit]
            if fits:
                s = max(fits, key=lambda s: (used[s], -open_.index(s)))
            else:
                if len(open_) >= P.OPEN:
                    open_.remove(max(open_, key=lambda s: (used[s], -s)))
                s = len(seqs)
                seqs.append([])
                open_.append(s)
            seqs[s].append((i, at, n - at, key))
            if sum(p[2] for p in seqs[s]) == limit:
                open_.remove(s)
    out = []
    for s, pieces in enumerate(seqs):
        off = 0
        for pos, (i, at, n, key) in enumerate(pieces):
            out.append((s, pos, i, at, n, off, key))
            off += n
    return out


def brute(rows, limit, cuts):
    """All of the packing, range by range; keys of grid points from a walk along the curve."""
    rows = [(i, t) for i, t in rows if t.split()]
    grid = np.array([slow_key(t) for _, t in rows])
    key = P.hilbert(grid)  # test_hilbert_is_a_curve
    pts = sorted(((int(k), i, len(t.split()) + 1) for (i, t), k in zip(rows, key)), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2]))
    ranges = {}
    for p in pts:
        ranges.setdefault(sum((c[0], c[1]) <= (p[0], P.NO_ID if p[1] is None else p[1]) for c in cuts), []).append(p)
    return sorted(((r, *x) for r, ps in ranges.items() for x in slow_pack(ps, limit)), key=str)


def test_packing(spark):
    r = random.Random(0)
    rows = [(i, " ".join(words(r.choice((1, 20, 90, 250, 700)), i))) for i in range(500)]
    plain = [(i, t) for i, t, *_ in rows + ODD if t is not None]
    df = docs(spark, rows + ODD)
    got = [tuple(x) for x in P.pack(df, limit=256).collect()]
    assert sorted(got, key=str) == brute(plain, 256, [])
    by_doc, by_seq = {}, {}
    for rg, s, pos, d, start, n, off, key in got:
        by_doc.setdefault(d, []).append((start, n))
        by_seq.setdefault((rg, s), []).append((pos, off, n))
    for i, t in rows:  # every document whole, once
        at = 0
        for start, n in sorted(by_doc[i]):
            assert start == at
            at += n
        assert at == len(t.split()) + 1
    for pieces in by_seq.values():
        at = 0
        for k, (pos, off, n) in enumerate(sorted(pieces)):
            assert (pos, off) == (k, at)
            at += n
        assert at <= 256
    used = sum(x[5] for x in got)
    assert used / (256 * len(by_seq)) > 0.8
    assert P.pack(docs(spark, [])).count() == 0
    assert P.pack(docs(spark, [(1, None), (2, " ")])).count() == 0


def test_ranges_depend_on_data_alone(spark):
    rows = [(i, " ".join(words(12, i))) for i in range(3000)]
    df = docs(spark, rows)
    small = 640
    a = sorted(map(tuple, P.pack(df, 64, small).collect()))
    b = sorted(map(tuple, P.pack(df.repartition(7), 64, small).collect()))
    assert a == b and len({x[0] for x in a}) > 1
    points = P.placed(df)
    cuts = sorted((x.key, x.i) for x in P.splitters(points, small).collect())
    assert sorted(a, key=str) == brute(rows, 64, cuts)


def test_operator_and_pipeline_count_tokens(spark, tmp_path):
    import corpus_pipeline
    from loomrecall.llm import queries
    from loomrecall.llm.tokenstore import VOCABULARY, tokenizer

    rows = [(1, "internationalisation of antidisestablishmentarianism"), (2, "x9" * 6000), (3, " \n"), (4, None), (5, "<|endoftext|> ä 漢字")]
    df = docs(spark, rows)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    t = tokenizer(VOCABULARY)
    want = {i: len(t.encode(x, disallowed_special=())) + 1 for i, x in rows if x and x.strip()}
    assert want[2] > P.MAX_TOKENS
    for out in (queries.op8_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, df, str(tmp_path))):
        got = {}
        for r in out.collect():
            assert r.offset + r.n_tokens <= P.MAX_TOKENS
            got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        assert got == want


def test_copies_with_one_key_spread_over_ranges(spark):
    rows = [(i, "the same words again") for i in range(2500)] + [(None, "the same words again")]
    got = [tuple(x) for x in P.pack(docs(spark, rows), 64, 640).collect()]
    cuts = sorted((x.key, x.i) for x in P.splitters(P.placed(docs(spark, rows)), 640).collect())
    assert len(cuts) > 1 and len({c[0] for c in cuts}) == 1
    assert sorted(got, key=str) == brute(rows, 64, cuts) and len({x[0] for x in got}) == len(cuts) + 1


def test_very_long_text_and_packed_ids(spark, tmp_path):
    from loomrecall.llm import tokenstore

    rows = [(1, " ".join(words(60_000, 1))), (2, "a b c"), (3, " "), (4, "d e"), (5, " ".join(words(3000, 2)))]
    df = docs(spark, rows)
    places = P.pack(df, counter=P.token_counts)
    tokenstore.write_store(df, str(tmp_path / "s"))
    got = {(r.range_id, r.sequence_id): r.token_ids for r in P.packed_tokens(places, tokenstore.read_tokens(spark, str(tmp_path / "s")), 7).collect()}
    t = tokenstore.tokenizer(tokenstore.VOCABULARY)
    ids = {i: t.encode(x, disallowed_special=()) + [7] for i, x in rows}
    seen = {}
    for r in places.collect():
        seq = got[(r.range_id, r.sequence_id)]
        assert len(seq) <= P.MAX_TOKENS and seq[r.offset : r.offset + r.n_tokens] == ids[r.doc_id][r.start_token : r.start_token + r.n_tokens]
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.n_tokens
    assert seen == {i: len(ids[i]) for i in (1, 2, 4, 5)} and sum(map(len, got.values())) == sum(seen.values())
