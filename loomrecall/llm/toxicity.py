"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on texts labelled ordinary, one on the matter
that sets texts labelled toxic apart: of each toxic text the chains of byte 5-grams found in
``LEAST_DOCS`` toxic documents whose share of them is ``LIFT`` times that of ordinary ones.
(Trained on whole toxic texts a dictionary fills with ordinary words, which tell nothing:
held-out recall is then under a half.) Both are loaded as raw content. The toxic side
compresses with its dictionary laid before the ordinary one as shared background, so
ordinary words cost the same on both sides and a window of ``WINDOW`` words, one of which
begins at every ``STEP``-th word, is shorter there only if it holds toxic matter. The
distance of a window is ordinary length minus toxic length, ``MOST`` at most; a document
scores the sum of its ``LARGEST`` largest distances. The threshold is calibrated
on labelled documents that took no part in training: the largest caught share minus
``PENALTY`` times the lost share of ordinary documents. Every document is scored over
its whole text.

The dictionaries are fitted on a bounded sample: the ``TRAIN_DOCS`` labelled documents
of either class with the smallest hash of doc_id, in the half of the hash space set
aside for training; their texts are read whole. Calibration uses all labelled documents of the other half.

Defined results: a null or blank text scores 0 and is never toxic; a score equal to the
threshold is toxic, and of thresholds of equal value the lowest is taken; documents whose
hashes tie are ordered by doc_id; very long texts are scored whole, window by window; without
labels, or without a toxic example, nothing is toxic; contradictory or null labels are left
out; rows that repeat a doc_id are each decided by their own text, and train and calibrate
with the smallest text; empty tables give empty results; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialize, record_batch, slices
from .textkit import _SPACE, string_buffer, words_of

WINDOW = 8
STEP = 2
LARGEST = 4
LEVEL = 6
MIN_MATCH = 6
GRAM = 5
LIFT = 20.0
LEAST_DOCS = 5
TRAIN_DOCS = 3000
ORDINARY_BYTES = 32768
TOXIC_BYTES = 2048
#: Segment and k-mer sizes by which zstandard picks the short runs of toxic matter.
TOXIC_SEGMENT, TOXIC_KMER = 16, 6
PENALTY = 10.0
MOST = 255
TOP = LARGEST * MOST


def _lower(data: np.ndarray) -> np.ndarray:
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    data[_SPACE[data]] = 32
    return data


def _grams(texts: list[str]):
    """For some texts after others: their bytes, row bounds, the byte 5-gram at each place, and
    which of these lie within a text and hold white space at most in front."""
    for at in range(0, len(texts), 64):
        data, offsets = string_buffer(pa.array([" " + t for t in texts[at : at + 64]], pa.large_string()))
        d = _lower(data)
        n = len(d) - GRAM + 1
        if n <= 0:
            continue
        g, ok = np.zeros(n, np.uint64), np.ones(n, bool)
        for i in range(GRAM):
            g = (g << np.uint64(8)) | d[i : i + n].astype(np.uint64)
            if i:
                ok &= d[i : i + n] != 32
        row = np.searchsorted(offsets, np.arange(n), side="right") - 1
        ok &= np.arange(n) + GRAM <= offsets[row + 1]
        yield d, offsets, row, g, ok


def _gram_docs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and their document counts."""
    found = [np.unique((g[ok] << np.uint64(20)) | row[ok].astype(np.uint64)) >> np.uint64(20) for _, _, row, g, ok in _grams(texts)]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def set_apart(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Of each toxic text the chains of grams that set toxic texts apart; texts without any left out."""
    gt, ct = _gram_docs(toxic)
    gn, cn = _gram_docs(ordinary)
    at = np.minimum(np.searchsorted(gn, gt), max(len(gn) - 1, 0))
    other = np.where(gn[at] == gt, cn[at], 0) if len(gn) else np.zeros(len(gt))
    hot = gt[(ct >= LEAST_DOCS) & (ct / len(toxic) > LIFT * (other + 0.5) / len(ordinary))]
    out = []
    for d, offsets, _, g, ok in _grams(toxic):
        hit = np.flatnonzero(ok & np.isin(g, hot))
        depth = np.zeros(len(d) + 1, np.int64)
        np.add.at(depth, hit, 1)
        np.add.at(depth, hit + GRAM, -1)
        inside = np.cumsum(depth[:-1]) > 0
        kept = np.concatenate([[0], np.cumsum(inside)])[offsets]
        buffer = d[inside].tobytes()
        out += [buffer[a:z] for a, z in zip(kept[:-1].tolist(), kept[1:].tolist()) if z > a]
    return out


def _trained(size: int, samples: list[bytes], **how) -> bytes:
    """A dictionary trained on the samples; where they are too few to train on, their end."""
    try:
        return zs.train_dictionary(size, samples, **how).as_bytes()
    except (zs.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def train(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes] | None:
    """(ordinary dictionary, toxic dictionary) or None if the texts don't differ."""
    if not toxic or not ordinary:
        return None
    apart = set_apart(toxic, ordinary)
    if not apart:
        return None
    base = _trained(ORDINARY_BYTES, [b" ".join(t.lower().encode().split()) + b" " for t in ordinary])
    return base, _trained(TOXIC_BYTES, apart, k=TOXIC_SEGMENT, d=TOXIC_KMER)


class Scorer:
    def __init__(self, ordinary: bytes, toxic: bytes):
        params = zs.ZstdCompressionParameters.from_level(
            LEVEL, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0,
            window_log=17, min_match=MIN_MATCH,
        )

        def compressor(content: bytes) -> zs.ZstdCompressor:
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            return zs.ZstdCompressor(dict_data=d, compression_params=params)

        self.sides = compressor(ordinary), compressor(toxic + ordinary)

    def distances(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row number and distance of every window."""
        w = words_of(text)
        if len(w.start) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.arange(len(w.start)) - w.first[w.row]
        left = w.first[w.row + 1] - np.arange(len(w.start))
        s = np.flatnonzero((place % STEP == 0) & ((place == 0) | (left > WINDOW - STEP)))
        e = np.minimum(s + WINDOW, w.first[w.row[s] + 1]) - 1
        begin = np.maximum(w.start[s] - 1, w.offsets[w.row[s]])
        spans = np.stack([begin, w.end[e] - begin], axis=1).astype(np.uint64)
        windows = zs.BufferWithSegments(_lower(w.data).tobytes(), spans.tobytes())
        a, b = (c.multi_compress_to_buffer(windows, threads=0) for c in self.sides)
        gain = np.fromiter((len(a[i]) - len(b[i]) for i in range(len(a))), np.int64, len(s))
        return w.row[s], gain

    def scores(self, text: pa.Array) -> np.ndarray:
        row, gain = self.distances(text)
        out = np.zeros(len(text), np.int64)
        if len(row):
            order = np.lexsort((-gain, row))
            r, g = row[order], np.clip(gain[order], 0, MOST)
            head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            nth = np.arange(len(r)) - np.repeat(head, np.diff(np.concatenate([head, [len(r)]])))
            np.add.at(out, r[nth < LARGEST], g[nth < LARGEST])
        return out


def _labelled(labels: DataFrame) -> DataFrame:
    return (
        labels.select(labels["doc_id"].cast("long").alias("i"), labels["toxic"].alias("x"))
        .where("i is not null and x in (0, 1)")
        .groupBy("i")
        .agg(F.min("x").alias("x"), F.max("x").alias("x2"))
        .where("x = x2")
        .select("i", "x", F.xxhash64("i").alias("h"))
    )


def fit(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes] | None:
    """Dictionaries from at most TRAIN_DOCS documents of either class."""
    from pyspark.sql import Window

    chosen = (
        _labelled(labels)
        .where("h & 1 = 0")
        .withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy("h", "i")))
        .where(F.col("n") <= TRAIN_DOCS)
        .select("i", "x")
    )
    text = docs.select(docs["doc_id"].cast("long").alias("i"), docs["text"].alias("t")).where("xxhash64(i) & 1 = 0 and length(trim(t)) > 0")
    # 2 * TRAIN_DOCS ids at most: a broadcast of fixed size
    rows = text.join(F.broadcast(chosen), "i").groupBy("i", "x").agg(F.min("t").alias("t")).orderBy("x", "i")
    toxic, ordinary = [], []
    for r in rows.toLocalIterator():
        (toxic if r["x"] else ordinary).append(r["t"])
    return train(toxic, ordinary)


def score(docs: DataFrame, model: tuple[bytes, bytes] | None) -> DataFrame:
    """(doc_id, score) of every row."""
    src = docs.select(docs["doc_id"].cast("long").alias("i"), docs["text"].alias("t"))
    if model is None:
        return src.select(F.col("i").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.int64())])

    def work(batches):
        scorer = Scorer(*model)
        for whole in batches:
            for b in slices(whole, "t"):
                yield record_batch(schema, [b.column(0), scorer.scores(b.column(1))])

    return src.mapInArrow(work, "doc_id long, score long")


def _held(labels: DataFrame) -> DataFrame:
    return _labelled(labels).where("h & 1 = 1").select("i", "x")


def calibrate(scores: DataFrame, held: DataFrame) -> int | None:
    """Threshold from the histogram of the scores of held-out documents (i, x); its size
    doesn't depend on the data."""
    hist = np.zeros((2, TOP + 1))
    rows = scores.join(held, scores["doc_id"] == held["i"]).groupBy("x", F.col("score").alias("s")).count()
    for r in rows.collect():  # at most 2 * (TOP + 1) rows
        hist[r["x"], r["s"]] += r["count"]
    if not hist[1].sum() or not hist[0].sum():
        return None
    share = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1] / hist.sum(axis=1, keepdims=True)
    value = share[1] - PENALTY * share[0]
    best = int(np.argmax(value[1:])) + 1
    return best if value[best] > 0 else None


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, threshold) of the documents that are toxic."""
    scores = materialize(score(docs, fit(docs, labels)), "toxicity")
    cut = calibrate(scores.groupBy("doc_id").agg(F.max("score").alias("score")), _held(labels))
    limit = F.lit(cut).cast("long")
    return scores.withColumn("threshold", limit).where(F.col("score") >= limit)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the toxic rows, all columns kept. The threshold comes from the held-out
    labelled documents, scored by themselves; the rest is one scan that scores and filters, so
    texts aren't shuffled (those of the hash space's other half are, where the held-out ids are
    too many to broadcast)."""
    model = fit(docs, labels)
    cut = None
    if model is not None:
        held = materialize(_held(labels), "held")
        texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).where("xxhash64(doc_id) & 1 = 1")
        texts = texts.join(bounded_broadcast(held.select(F.col("i").alias("doc_id")), held.count(), 9), "doc_id", "left_semi")
        cut = calibrate(score(texts, model).groupBy("doc_id").agg(F.max("score").alias("score")), held)
    if cut is None:
        return docs
    at = docs.columns.index("text")

    def work(batches):
        scorer = Scorer(*model)
        for whole in batches:
            for b in slices(whole, "text"):
                yield b.filter(pa.array(scorer.scores(b.column(at)) < cut))

    return docs.mapInArrow(work, docs.schema)
