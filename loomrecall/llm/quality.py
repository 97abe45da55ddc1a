"""Quality rules with risk-controlled thresholds.

Five shares measure a document: symbols, shouting (capitals and exclamation marks),
words equal to the word before, list bars, and repeated lines. A rule rejects a
document whose share reaches the cutoff of its stratum (language). Cutoffs come from
the labelled holdout: for each stratum and rule the cutoffs 1.00, 0.99, ... are tested
in this fixed order with the exact (Clopper-Pearson) upper bound on the share of good
documents that the cutoff rejects; testing stops at the first bound above the risk, so
no correction is due within a sequence, and the level is divided by the number of
sequences (Bonferroni over strata and rules). With probability 1 - delta no stratum
loses more than ``risk`` of its good documents. Of the certified cutoffs the one with
the best (caught share of bad documents - penalty * lost share of good ones) is used.

Defined results: a null or blank text has no words and is rejected; a null language
is the stratum ""; a stratum without enough labels to certify a cutoff gets none, and
its rule rejects nothing there; labels that are null, not 0/1 or contradictory for a
doc_id are left out; rows that repeat a doc_id are decided by their own text; an
empty table gives an empty result; extra columns are carried along untouched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, record_batch, slices
from .textkit import words_of

RULES = ("symbols", "shouting", "stutter", "bars", "lines")
STEPS = 100
RISK = 0.05
DELTA = 0.05
PENALTY = 20.0

_SYMBOL = np.zeros(256, dtype=np.uint8)
_SYMBOL[[ord(c) for c in "#$%&*@^~<>{}[]\\_=+"]] = 1
_SHOUT = np.zeros(256, dtype=np.uint8)
_SHOUT[65:91] = 1
_SHOUT[ord("!")] = 1
_BAR = np.zeros(256, dtype=np.uint8)
_BAR[ord("|")] = 1


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def shares(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x rules) shares in [0, 1] and the number of words of each text."""
    w = words_of(text)
    size = np.maximum(np.diff(w.offsets), 1)
    n_words = np.diff(w.first)
    h = w.hashes(fold=False)
    again = np.zeros(len(h), dtype=np.int64)
    again[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    lines = np.zeros(len(size))
    for i, t in enumerate(text):
        parts = [p for p in (t.as_py() or "").split("\n") if p.strip()]
        if len(parts) > 1:
            lines[i] = 1 - len(set(parts)) / len(parts)
    words = np.maximum(n_words, 1)
    out = np.stack(
        [
            _per_text(_SYMBOL[w.data], w.offsets) / size,
            _per_text(_SHOUT[w.data], w.offsets) / size,
            _per_text_words(again, w.first) / words,
            np.minimum(1.0, _per_text(_BAR[w.data], w.offsets) / words),
            lines,
        ],
        axis=1,
    )
    return out, n_words


def _per_text_words(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[first[1:]] - total[first[:-1]]


def _steps(values: np.ndarray) -> np.ndarray:
    """Cutoff number a share reaches: share >= c/STEPS for c <= step."""
    return np.floor(values * STEPS + 1e-9).astype(np.int32)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, n_words, a step 0..STEPS for each rule) of every row."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("stratum", pa.string()), ("n_words", pa.int64())] + [(r, pa.int32()) for r in RULES]
    )

    def work(batches):
        for whole in batches:
            for b in slices(whole, "t"):
                s, n = shares(b.column(1))
                k = _steps(s)
                yield record_batch(schema, [b.column(0), b.column(2), n, *(k[:, i] for i in range(len(RULES)))])

    src = pick(docs, i="doc_id", t="text", g="lang").select(
        F.col("i").cast("long").alias("i"), "t", F.coalesce("g", F.lit("")).alias("g")
    )
    return src.mapInArrow(work, "doc_id long, stratum string, n_words long, " + ", ".join(f"{r} int" for r in RULES))


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    f = d
    for m in range(1, 100_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * f / a


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson upper confidence bound of a share, k of n seen, error ``level``."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if _betainc(k + 1, n - k, mid) < 1 - level:
            lo = mid
        else:
            hi = mid
    return hi


def certify(good: np.ndarray, bad: np.ndarray, risk: float, level: float, penalty: float = PENALTY) -> int | None:
    """Cutoff (in steps) from histograms of steps 0..STEPS, or None if none is certified."""
    n, m = int(good.sum()), int(bad.sum())
    lost, caught = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    best, best_value = None, -math.inf
    for c in range(STEPS, 0, -1):
        if n == 0 or upper_bound(int(lost[c]), n, level) > risk:
            break
        value = (caught[c] / m if m else 0.0) - penalty * lost[c] / n
        if value > best_value:  # ties: the mildest cutoff
            best, best_value = c, value
    return best


def thresholds(feats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[tuple[str, str], int]:
    """{(stratum, rule): cutoff}. All labelled rows count; what reaches the driver is a
    histogram of strata x rules x steps, whatever the size of the tables."""
    lab = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].alias("q"))
        .where("doc_id is not null and q in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("q").alias("q"), F.max("q").alias("q2"))
        .where("q = q2")
        .select("doc_id", "q")
    )
    seen = feats.where("n_words > 0").join(lab, "doc_id")
    hist = (
        seen.select("stratum", "q", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES))).alias("x"))
        .groupBy("stratum", "q", "x.rule", "x.step")
        .count()
    )
    counts: dict[tuple[str, str], np.ndarray] = {}
    for r in hist.toLocalIterator():
        counts.setdefault((r["stratum"], r["rule"]), np.zeros((2, STEPS + 1), np.int64))[r["q"], min(r["step"], STEPS)] += r["count"]
    level = delta / max(1, len(counts))
    found = {k: certify(h[1], h[0], risk / len(RULES), level) for k, h in sorted(counts.items())}
    return {k: c for k, c in found.items() if c is not None}


def _rejected(steps: np.ndarray, strata: list, n_words: np.ndarray, cut: dict) -> np.ndarray:
    out = n_words == 0
    limit = np.array([[cut.get((s, r), STEPS + 1) for r in RULES] for s in strata]).reshape(len(strata), len(RULES))
    return out | (steps >= limit).any(axis=1)


def quality_report(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """Documents kept by the rules: doc_id, stratum, n_words and their shares in steps of 1/100."""
    feats = materialize(features(docs), "quality")
    cut = thresholds(feats, labels, **kw)
    bad = F.col("n_words") == 0
    for (stratum, rule), c in cut.items():
        bad = bad | ((F.col("stratum") == stratum) & (F.col(rule) >= c))
    return feats.where(~bad)


def keep_good(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """docs without the rejected rows, all columns kept. The second pass filters while
    scanning: texts are never shuffled."""
    cut = thresholds(features(docs), labels, **kw)
    at = docs.columns.index("text"), docs.columns.index("lang")

    def work(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                s, n = shares(b.column(at[0]))
                strata = b.column(at[1]).fill_null("").to_pylist()
                yield b.filter(pa.array(~_rejected(_steps(s), strata, n, cut)))

    return docs.mapInArrow(work, docs.schema)
