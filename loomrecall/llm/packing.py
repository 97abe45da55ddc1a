"""Sequence packing along a Hilbert curve.

A document's hashed word counts (``DIM`` signed buckets, scaled to unit length) are
projected to ``AXES`` dimensions by a fixed random matrix and mapped to a Hilbert key.
The corpus is range-partitioned by (key, doc_id) and packed in that order, so documents
that share a sequence are neighbours on the curve. Only ids, keys and lengths are
shuffled, never texts.

Ranges are cut at splitters: (key, doc_id) of the documents whose hash falls under a set
share, so where sequences may begin anew depends on the data alone, not on partitions
or executors, and thousands of copies with one key spread over ranges. Within a range, documents fill up to ``OPEN`` open sequences: each goes
to the open sequence that it fills best; if it fits none, a new one is opened and, past
``OPEN``, the fullest one closed. Documents longer than ``MAX_TOKENS`` are cut into full
sequences of their own and a rest that is packed like a short document. Lengths are
what a counter finds in the whole text plus one separator a document. The counter is a
parameter: ``token_counts`` (the BPE of operators 2 and 6), which operator 8 and the
pipeline use, or by default ``word_counts``. ``packed_tokens`` joins the places with a token
store and gives the sequences' token ids.

Defined results: null and blank texts have no tokens and aren't packed; null doc_ids
sort first; repeated rows are packed once each; ties on the curve go by doc_id, then
length; a very long text is counted whole and cut into as many full sequences as it fills; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import numbered
from .common import materialize, record_batch, slices
from .textkit import mix64, words_of
from .tokenstore import VOCABULARY, tokenizer

MAX_TOKENS = 2048
DIM = 64
AXES = 3
BITS = 10
OPEN = 32
RANGE_DOCS = 50_000
#: Place of null ids in the order.
NO_ID = -(1 << 63)
SCHEMA = "range_id int, sequence_id long, position int, doc_id long, start_token long, n_tokens int, offset int, hilbert_key long"


def hilbert(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of integer points (rows) by transposed Gray-code steps."""
    x = coords.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(20240601).standard_normal((DIM, AXES)) / np.sqrt(AXES)


Counter = Callable[[pa.Array], np.ndarray]


def word_counts(text: pa.Array) -> np.ndarray:
    """White-space words of each text."""
    return np.diff(words_of(text).first)


def token_counts(text: pa.Array) -> np.ndarray:
    """BPE tokens of each text."""
    t = tokenizer(VOCABULARY)
    return np.array([0 if x is None else len(t.encode_to_numpy(x, disallowed_special=())) for x in text.to_pylist()], np.int64)


def keys(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hilbert keys and word counts."""
    w = words_of(text, alnum=True)
    h = mix64(w.hashes() + np.uint64(3))
    cell = w.row * DIM + (h % np.uint64(DIM)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    v = np.bincount(cell, weights=sign, minlength=len(text) * DIM).reshape(len(text), DIM)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    point = v / np.maximum(norm, 1e-12) @ _projection()
    # unit vectors project into about +-2; the ends are clipped
    grid = np.clip(((point + 2) / 4 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert(grid), np.diff(words_of(text).first)


def placed(docs: DataFrame, counter: Counter = word_counts) -> DataFrame:
    """(i, key, n): id, Hilbert key and length of every document that has words."""
    schema = pa.schema([("i", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])

    def work(batches):
        for whole in batches:
            for b in slices(whole, "t"):
                k, n = keys(b.column(1))
                some = n > 0
                if counter is not word_counts:
                    n = counter(b.column(1))
                yield record_batch(schema, [b.column(0).filter(pa.array(some)), k[some], n[some] + 1])

    src = docs.select(docs["doc_id"].cast("long").alias("i"), docs["text"].alias("t"))
    return src.mapInArrow(work, "i long, key long, n long")


def pack_range(ids: list, key: list[int], n: list[int], limit: int = MAX_TOKENS) -> list[tuple]:
    """(sequence, position, doc, start token, tokens, offset, key) of one range in curve order."""
    out, opened, next_id = [], [], 0  # opened: [sequence, used, pieces]
    for i, k, size in zip(ids, key, n):
        start = 0
        while size - start >= limit:
            out.append((next_id, 0, i, start, limit, 0, k))
            next_id += 1
            start += limit
        rest = size - start
        if not rest:
            continue
        best = None
        for s in opened:
            if s[1] + rest <= limit and (best is None or s[1] > best[1]):
                best = s
        if best is None:
            if len(opened) >= OPEN:
                opened.remove(max(opened, key=lambda s: (s[1], -s[0])))
            best = [next_id, 0, 0]
            next_id += 1
            opened.append(best)
        out.append((best[0], best[2], i, start, rest, best[1], k))
        best[1] += rest
        best[2] += 1
        if best[1] == limit:
            opened.remove(best)
    return out


def splitters(points: DataFrame, range_docs: int = RANGE_DOCS) -> DataFrame:
    """(key, i), ascending, at which ranges begin: of every 64th of a range's documents, chosen
    by hash, each 64th."""
    share = max(1, range_docs // 64)
    chosen = points.where(F.pmod(F.xxhash64("i", "n"), F.lit(share)) == 0).select("key", F.coalesce("i", F.lit(NO_ID)).alias("i"))
    return numbered(chosen, ["key", "i"], "m").where("m % 64 = 0").select("key", "i").distinct()


def range_of(cuts: np.ndarray, key: np.ndarray, i: np.ndarray) -> np.ndarray:
    """How many cuts (rows key, id) are not above (key, i)."""
    lo, hi = (np.searchsorted(cuts[:, 0], key, side=side) for side in ("left", "right"))
    out = lo.copy()
    some = np.flatnonzero(lo < hi)
    for k in np.unique(key[some]):  # keys of cuts only
        at = some[key[some] == k]
        a, z = lo[at[0]], hi[at[0]]
        out[at] = a + np.searchsorted(cuts[a:z, 1], i[at], side="right")
    return out


def pack(docs: DataFrame, limit: int = MAX_TOKENS, range_docs: int = RANGE_DOCS, counter: Counter = word_counts) -> DataFrame:
    """Every piece's place: range, sequence (unique within the range), position, document,
    first token and number of tokens, offset in the sequence, Hilbert key."""
    points = materialize(placed(docs, counter), "points")
    # a cut for some 50,000 documents
    cuts = np.array(sorted((r["key"], r["i"]) for r in splitters(points, range_docs).toLocalIterator()), np.int64).reshape(-1, 2)
    schema = pa.schema(
        [
            ("range_id", pa.int32()), ("sequence_id", pa.int64()), ("position", pa.int32()), ("doc_id", pa.int64()),
            ("start_token", pa.int64()), ("n_tokens", pa.int32()), ("offset", pa.int32()), ("hilbert_key", pa.int64()),
        ]
    )

    def work(batches):
        rest = None  # the range that the last batch ended in
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            r = ranges(t)
            whole = int(np.searchsorted(r, r[-1])) if len(r) else 0
            if whole:
                yield from pieces(t.slice(0, whole), r[:whole])
            rest = t.slice(whole)
        if rest is not None and rest.num_rows:
            yield from pieces(rest, ranges(rest))

    def ranges(t):
        return range_of(cuts, t.column("key").to_numpy(), t.column("i").fill_null(NO_ID).to_numpy())

    def pieces(t, r):
        ids, key, n = (t.column(c).to_pylist() for c in ("i", "key", "n"))
        edge = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1], [True]])).tolist()
        for a, z in zip(edge, edge[1:]):
            got = pack_range(ids[a:z], key[a:z], n[a:z], limit)
            c = list(zip(*got))
            yield record_batch(schema, [np.full(len(got), r[a], np.int32), *(pa.array(v, f.type) for v, f in zip(c, list(schema)[1:]))])

    # splitters to hand, Spark's range partitioning would cut elsewhere: ranges are hashed whole
    @F.pandas_udf("int")
    def number(k: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series(range_of(cuts, k.to_numpy(), i.to_numpy()).astype(np.int32))

    r = number("key", F.coalesce("i", F.lit(NO_ID))) if len(cuts) else F.lit(0)
    by_range = points.withColumn("r", r).repartition("r").sortWithinPartitions("r", "key", "i", "n")
    return by_range.select("i", "key", "n").mapInArrow(work, SCHEMA)


def packed_tokens(places: DataFrame, tokens: DataFrame, separator: int) -> DataFrame:
    """(range_id, sequence_id, n_tokens, token_ids): the sequences' ids, a separator after each
    document. tokens: a token store with one row a doc_id; a sequence is one group of
    MAX_TOKENS ids at most."""
    ids = F.concat(F.col("token_ids"), F.array(F.lit(separator)))
    piece = places.join(tokens.select("doc_id", "token_ids"), "doc_id").select(
        "range_id", "sequence_id", F.struct("position", F.slice(ids, (F.col("start_token") + 1).cast("int"), F.col("n_tokens")).alias("ids")).alias("p")
    )
    whole = F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["ids"]))
    out = piece.groupBy("range_id", "sequence_id").agg(whole.alias("token_ids"))
    return out.select("range_id", "sequence_id", F.size("token_ids").alias("n_tokens"), "token_ids")
