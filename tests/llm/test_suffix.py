import random

from loomrecall.llm import suffix as S

from .kit import ODD, docs, words

M = 50


def brute(rows, m=M):
    first = {}
    for i, t in sorted(rows):
        w = t.split()
        for s in range(len(w) - m + 1):
            first.setdefault(tuple(w[s : s + m]), i)
    out = {}
    for i, t in rows:
        w, gone = t.split(), set()
        for s in range(len(w) - m + 1):
            if first[tuple(w[s : s + m])] < i:
                gone.update(range(s, s + m))
        if gone:
            out[i] = gone
    return out


def corpus():
    r = random.Random(1)
    passages = [words(n, n) for n in (49, 50, 51, 80, 200)]
    rows = []
    for d in range(60):
        w = words(r.choice((0, 10, 60, 300)), 1000 + d)
        for p in r.sample(passages, r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at:at] = p
        rows.append((d, " ".join(w)))
    rows.append((60, rows[10][1]))  # exact copies
    rows.append((61, rows[10][1]))
    rows.append((62, " ".join(["rew"] * 400)))  # one word over and over
    rows.append((63, "x " + " ".join(["rew"] * 130) + " y " + " ".join(["rew"] * 70)))
    rows.append((64, " ".join(words(7, 3) * 40)))  # a period of seven
    rows.append((65, " ".join(words(300, 9) + words(7, 3) * 20)))
    rows.append((66, " ".join(passages[3] + passages[4] + passages[3])))  # own repeats
    return rows


def test_spans_match_brute_force(spark):
    rows = corpus()
    got = {}
    for r in S.repeated_passages(docs(spark, rows + ODD)).collect():
        assert r.end - r.begin >= M and r.first_doc_id < r.doc_id
        got.setdefault(r.doc_id, set()).update(range(r.begin, r.end))
    assert got == brute(rows)


def test_texts_lose_repeats(spark):
    rows = corpus()
    gone = brute(rows)
    df = docs(spark, rows + ODD)
    out = S.drop_repeats(df)
    assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
    got = out.collect()
    text = {r.doc_id: r.text for r in got}
    for i, t in rows:
        left = [w for k, w in enumerate(t.split()) if k not in gone.get(i, ())]
        if i not in gone:
            assert text[i] == t
        elif left:
            assert text[i].split() == left
        else:
            assert i not in text
    assert sorted(str(r.doc_id) for r in got if r.doc_id is None or r.doc_id > 900) == sorted(str(r[0]) for r in ODD)
    assert all(r.n_chars == len(r.text) for r in got if r.doc_id in gone)


def test_very_long_and_empty(spark):
    long = " ".join(words(120_000, 4, length=7))
    df = docs(spark, [(1, long), (2, "z " + long)])
    r = S.repeated_passages(df).collect()
    assert [(x.doc_id, x.begin, x.end, x.first_doc_id) for x in r] == [(2, 1, 120_001, 1)]
    assert S.repeated_passages(docs(spark, [])).count() == 0
    assert S.drop_repeats(docs(spark, [])).count() == 0


def test_rows_that_repeat_an_id(spark):
    t = " ".join(words(80, 2))
    df = docs(spark, [(1, t), (1, t), (2, t), (None, t), (None, t)])
    assert sorted(str(r.doc_id) for r in S.drop_repeats(df).collect()) == ["1", "1", "None", "None"]


def test_multikey_order():
    import numpy as np

    r = np.random.default_rng(0)
    w = r.integers(0, 3, 400).astype("<u4")
    where = np.arange(0, 390)
    live, label = S.equal_windows(w, where, np.zeros(390, np.int64), 9)
    seen = {}
    for i in where:
        seen.setdefault(tuple(w[i : i + 9]), []).append(int(i))
    want = sorted(tuple(v) for v in seen.values() if len(v) > 1)
    got = {}
    for i, g in zip(live.tolist(), label.tolist()):
        got.setdefault(g, []).append(i)
    assert sorted(tuple(sorted(v)) for v in got.values()) == want


def test_different_texts_under_one_id(spark):
    p, q = words(60, 11), words(70, 12)
    a, b = words(90, 21) + p + words(5, 22), words(10, 23) + q + words(200, 24)
    c = words(30, 25)
    inside = words(55, 26)  # twice within document 3 only
    rows = [(1, " ".join(p)), (2, " ".join(q)), (3, " ".join(a + inside)), (3, " ".join(b)), (3, " ".join(c + inside)), (3, " ".join(b)), (4, " ".join(b))]
    spans = {(r.doc_id, r.begin, r.end, r.first_doc_id) for r in S.repeated_passages(docs(spark, rows)).collect()}
    assert spans == {(3, 90, 150, 1), (3, 10, 80, 2), (4, 0, 280, 2)}
    got = sorted((r.doc_id, r.text.split()) for r in S.drop_repeats(docs(spark, rows)).collect())
    left = b[:10] + b[80:]
    assert got == sorted([(1, p), (2, q), (3, a[:90] + a[150:] + inside), (3, left), (3, c + inside), (3, left)])


def test_anchors_of_texts_longer_than_a_block():
    import numpy as np

    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    x[500:900] = x[500]  # ties go to the first
    want = [i + int(np.argmin(x[i : i + 43] >> np.uint64(24))) for i in range(4000 - 42)]
    for block in (1 << 24, 100, 43, 1000):
        assert S._places_of_min(x, 43, block).tolist() == want
    n = (1 << 24) + 200_000
    x = r.integers(0, 1 << 63, n, dtype=np.uint64)
    got = S._places_of_min(x, 43)
    i = np.arange(len(got))
    assert len(got) == n - 42 and (got >= i).all() and (got < i + 43).all()
    assert (x[got] >> np.uint64(24) <= x[i + 42] >> np.uint64(24)).all()
