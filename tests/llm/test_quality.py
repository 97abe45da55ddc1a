import math

import numpy as np

from loomrecall.llm import quality as Q

from .kit import ODD, docs, words


def brute_bound(k, n, level):
    """Largest p with P(X <= k) >= level, by summing the binomial."""
    lo, hi = k / n, 1.0
    for _ in range(80):
        p = (lo + hi) / 2
        tail = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        lo, hi = (p, hi) if tail > level else (lo, p)
    return hi


def test_bound_is_exact():
    for k, n, level in ((0, 10, 0.05), (3, 50, 0.01), (20, 40, 0.1), (0, 700, 0.0025), (5, 6, 0.2)):
        assert abs(Q.upper_bound(k, n, level) - brute_bound(k, n, level)) < 1e-6
    assert Q.upper_bound(5, 5, 0.05) == 1.0


def test_certified_cutoffs_hold_their_risk():
    """Over many holdouts drawn from a known law, no certified cutoff loses more than the risk."""
    r = np.random.default_rng(0)
    broken = 0
    for _ in range(200):
        good = np.bincount(np.minimum(r.geometric(0.2, 600) - 1, Q.STEPS), minlength=Q.STEPS + 1)
        bad = np.bincount(r.integers(20, 90, 100), minlength=Q.STEPS + 1)
        c = Q.certify(good, bad, 0.02, 0.05, penalty=0.0)
        broken += c is not None and 0.8**c > 0.02
    assert broken <= 200 * 0.05 + 6


def test_no_labels_no_cutoff():
    assert Q.certify(np.zeros(101, int), np.zeros(101, int), 0.05, 0.05) is None
    few = np.zeros(101, int)
    few[0] = 20
    assert Q.certify(few, few, 0.01, 0.01) is None


def brute(rows, labels):
    """Shares, thresholds and decisions in plain Python."""
    def steps(t):
        b = t.encode()
        w = t.split()
        lines = [x for x in t.split("\n") if x.strip()]
        v = [sum(c in b"#$%&*@^~<>{}[]\\_=+" for c in b) / max(len(b), 1), sum(65 <= c <= 90 or c == 33 for c in b) / max(len(b), 1),
             sum(x == y for x, y in zip(w, w[1:])) / max(len(w), 1), min(1, t.count("|") / max(len(w), 1)), 1 - len(set(lines)) / len(lines) if len(lines) > 1 else 0]
        return [math.floor(x * 100 + 1e-9) for x in v]
    lab = {}
    for d, q in labels:
        lab.setdefault(d, set()).add(q)
    hist = {}
    for d, t, g in rows:
        if t.split() and len(lab.get(d, ())) == 1:
            for r, s in zip(Q.RULES, steps(t)):
                hist.setdefault((g, r), np.zeros((2, 101), int))[next(iter(lab[d])), s] += 1
    cut = {k: Q.certify(h[1], h[0], Q.RISK / 5, Q.DELTA / len(hist)) for k, h in hist.items()}
    return {d for d, t, g in rows if t.split() and not any(cut.get((g, r)) is not None and s >= cut[(g, r)] for r, s in zip(Q.RULES, steps(t)))}, cut


def test_decisions_match_brute_force(spark):
    rows, labels = [], []
    for d in range(2400):
        w = words(30, d)
        kind = d % 8
        if kind == 1:
            w = [x + "$$$" for x in w]
        elif kind == 2:
            w = [x.upper() + "!!" for x in w]
        elif kind == 3:
            w = [x for x in w[:10] for _ in range(3)]
        elif kind == 4:
            w = [x + " |" for x in w]
        rows.append((d, " ".join(w), "en" if d % 3 else "de"))
        labels.append((d, int(kind not in (1, 2, 3, 4))))
    labels += [(5, 0), (None, 1), (7, None)]
    want, cut = brute(rows, labels)
    df = docs(spark, rows + ODD)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    assert {k: v for k, v in cut.items() if v is not None} == Q.thresholds(Q.features(df), lab)
    kept = [x.doc_id for x in Q.keep_good(df, lab).collect()]
    odd = [None, 904, 904, 905]
    assert sorted(kept, key=str) == sorted([*want, *odd], key=str)
    assert sorted((x.doc_id for x in Q.quality_report(df, lab).collect()), key=str) == sorted(kept, key=str)
    # the smaller stratum has too few labels to certify anything
    assert len(want) < 1700 and all(d % 8 not in (1, 2, 3, 4) for d in want if d % 3)
    assert Q.keep_good(df, lab).columns == df.columns


def test_empty(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.keep_good(docs(spark, []), lab).count() == 0
    assert Q.quality_report(docs(spark, []), lab).count() == 0
    assert Q.keep_good(docs(spark, [(1, "a b $$$$$$$$")]), lab).count() == 1
