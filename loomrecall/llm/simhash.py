"""SimHash near-duplicates over navigable small-world graphs.

A document is described by the 128-bit SimHash of its distinct words (runs of letters,
digits and non-ASCII characters, ASCII case folded) and a one-permutation MinHash
sketch of ``BINS`` 16-bit values. Documents with equal descriptions collapse to the
smallest doc_id first, by an aggregate with map-side combine, so thousands of copies cost
one row.

Routing. Shards hold documents that agree on a band of sketch bins. A pair of Jaccard
similarity J agrees on a band of r bins with probability J**r, unrelated documents
(J of some hundredths) hardly ever, so bands narrow shards far more than bands of
SimHash bits, of which unrelated documents share over half. r is the least number of bins
whose mean shard, counted over all documents, holds ``SHARD_ROWS``; the number of bands
follows from r so that a pair at ``LEAST_JACCARD`` shares one with ``MEET`` at least,
whatever the rows. On top of that ``AUDIT_ALL`` queries are compared with all documents,
and bands are added until as many of the verified pairs found so share one. Bins that are
empty take the next filled bin's value, so short texts have bands too. Shards of over
``HOT_ROWS`` are banded again by one bin more (each row goes to ``MEET``'s number of
sub-bands); what bins can't split further, and shards over ``4 * SHARD_ROWS``, are cut into
parts by hash, and every row queries all parts but those its partners query from.

Search. A shard's rows enter a navigable small-world graph over Hamming distance in
batches; every row is a query when it enters, against all rows before it, by a beam search
from fixed entry points. The beam doubles while all it holds lies within ``RADIUS``; one
that reaches an eighth of the graph becomes an exact scan, so there is no cap on partners.
Shards of up to ``EXACT_ROWS`` rows, where a graph has nothing to skip, are scanned exactly. Each
graph audits its recall against an exact scan of ``AUDIT`` of its queries; below
``LEAST_RECALL`` it is built again with twice the beam, and at last the shard is scanned
exactly. ``shard_audits`` gives the figures of all shards, ``measured_recall`` that of the
whole search against an exact scan of all documents.

Pairs within the radius are verified by the Jaccard estimate of their sketches
(``LEAST_JACCARD``), batches reduce them to spanning stars and counts, and a global
large-star / small-star iteration unites the stars. One document of each group, the
smallest doc_id, stays. ``links`` counts a document's verified partners among the groups of
equal descriptions: a pair counts in the first band it shares only (a lower bound where
shards were banded again).

Defined results: null, blank and wordless texts are never duplicates; rows without a
doc_id are never duplicates; rows that repeat a doc_id share one decision and never
duplicate each other; ties go to the smallest doc_id; very long texts are read whole;
empty tables give empty results; extra columns stay.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialize, record_batch, slices
from .textkit import mix64, words_of

RADIUS = 28
BITS = 128
LEAST_JACCARD = 0.65
BINS = 128
MEET = 0.95
SHARD_ROWS = 8192
HOT_ROWS = 1 << 18
LEVELS = 8
EXACT_ROWS = 256
AUDIT = 64
AUDIT_ALL = 512
LEAST_RECALL = 0.9
DEGREE = 16
LONG = 4
BEAM = 32
NEAREST = 8
ENTRIES = 128
EXPAND = 4
SHIFTS = 48
_EMPTY = 0xFFFF
_NONE = np.uint64((1 << 64) - 2)
_ONE = np.uint64(1)
_ID = np.uint64((1 << 40) - 1)
_D = np.uint64(40)


def describe(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the rows that have words, their SimHashes and their sketches."""
    w = words_of(text, alnum=True)
    h = w.hashes()
    order = np.lexsort((h, w.row))
    h, row = h[order], w.row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    if not len(h):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), np.zeros((0, BINS), np.uint16)
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    rows, sizes = row[begin], np.diff(np.concatenate([begin, [len(row)]]))
    both = np.stack([mix64(h + np.uint64(1)), mix64(h + np.uint64(4))], axis=1)
    # ones of each bit: bytes of 0 or 1 are added eight at a time, up to 255 words of a text at once
    place = np.arange(len(h)) - np.repeat(begin, sizes)
    part = np.flatnonzero(place % 255 == 0)
    lanes = np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
    counted = np.add.reduceat(lanes, part, axis=0).view(np.uint8)
    ones = np.add.reduceat(counted, np.searchsorted(part, begin), axis=0, dtype=np.int32)
    sig = np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64)
    m = mix64(h + np.uint64(2))
    sketch = np.full((len(rows), BINS), _EMPTY, np.uint16)
    slot = np.repeat(np.arange(len(rows)), sizes) * BINS + (m % np.uint64(BINS)).astype(np.int64)
    np.minimum.at(sketch.reshape(-1), slot, np.minimum(m >> np.uint64(48), np.uint64(_EMPTY - 1)).astype(np.uint16))
    return rows, sig, sketch


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances; the last axis holds the two words of a signature."""
    return np.bitwise_count(a[..., 0] ^ b[..., 0]) + np.bitwise_count(a[..., 1] ^ b[..., 1])


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketch pairs, bins empty on both sides left out."""
    filled = ((a != _EMPTY) | (b != _EMPTY)).sum(axis=-1)
    return ((a == b) & (a != _EMPTY)).sum(axis=-1) / np.maximum(filled, 1)


def alike(sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows verify."""
    ok = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 15):
        s = slice(at, at + (1 << 15))
        ok[s] = jaccard(sketch[a[s]], sketch[b[s]]) >= LEAST_JACCARD
    return ok


def signatures(docs: DataFrame) -> DataFrame:
    """(i, s0, s1, sketch) of the documents that have words."""
    schema = pa.schema([("i", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), ("sketch", pa.binary())])

    def work(batches):
        for whole in batches:
            for b in slices(whole, "t"):
                rows, sig, sketch = describe(b.column(1))
                packed = [s.tobytes() for s in sketch]
                yield record_batch(schema, [np.asarray(b.column(0))[rows], *sig.view(np.int64).T, pa.array(packed, pa.binary())])

    src = docs.select(docs["doc_id"].cast("long").alias("i"), docs["text"].alias("t")).where("i is not null and t is not null")
    return src.mapInArrow(work, "i long, s0 long, s1 long, sketch binary")


def sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BINS)


# --- bands ---------------------------------------------------------------------------------


def dense(sketch: np.ndarray) -> np.ndarray:
    """Value and bin number of each bin, empty bins taking those of the next filled one."""
    where = np.where(sketch != _EMPTY, np.arange(BINS), 2 * BINS)
    twice = np.concatenate([where, np.minimum(where + BINS, 2 * BINS)], axis=1)
    source = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :BINS] % BINS
    return (np.take_along_axis(sketch, source, axis=1).astype(np.uint64) << np.uint64(8)) | source.astype(np.uint64)


def routes_for(bins: int, share: float = MEET) -> int:
    """Bands of so many bins of which a pair at LEAST_JACCARD shares one with the given probability."""
    return int(np.ceil(np.log1p(-share) / np.log1p(-(LEAST_JACCARD**bins))))


@lru_cache(maxsize=64)
def band(number: int, bins: int) -> tuple[int, ...]:
    """Bins of a band: disjoint ones as long as the bins last, then of another order."""
    turn, at = divmod(number, BINS // bins)
    order = np.random.default_rng(turn).permutation(BINS)
    return tuple(order[at * bins : (at + 1) * bins].tolist())


def sub_bin(level: int, k: int) -> int:
    """The bin by which sub-band k of a level splits a shard."""
    return int(np.random.default_rng(10_007).permutation(BINS)[(level * routes_for(1) + k) % BINS])


def band_key(values: np.ndarray, bins: tuple[int, ...], salt: np.ndarray | int) -> np.ndarray:
    """Bucket number: the dense values of the bins, mixed with a salt."""
    key = np.broadcast_to(np.asarray(salt).astype(np.uint64), len(values)).copy()
    for b in bins:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + values[:, b] + np.uint64(1))
    return key.view(np.int64)


def earlier(path: str, bins: int) -> list[tuple[int, ...]]:
    """Bins of the bands in which a pair of this shard may have met before."""
    steps = [int(x) for x in path.split(".")]
    out = [band(t, bins) for t in range(steps[0])]
    return out + [(sub_bin(level, k),) for level, last in enumerate(steps[1:]) for k in range(last)]


def mean_shards(reps: DataFrame, most: int) -> list[float]:
    """For 1..most bins a band: the mean, over all documents, of the rows in the document's shard."""
    schema = pa.schema([("r", pa.int32()), ("b", pa.int64())])

    def work(batches):
        for t in batches:
            if t.num_rows:
                values = dense(sketches(t.column(0)))
                for r in range(1, most + 1):
                    yield record_batch(schema, [np.full(len(values), r, np.int32), band_key(values, band(0, r), 0)])

    counts = reps.select("sketch").mapInArrow(work, "r int, b long").groupBy("r", "b").count()
    n = F.col("count").cast("double")
    got = {x["r"]: x["mean"] for x in counts.groupBy("r").agg((F.sum(n * n) / F.sum(n)).alias("mean")).collect()}
    return [got.get(r, 0.0) for r in range(1, most + 1)]


def audited_routes(reps: DataFrame, bins: int, least: int) -> int:
    """How many bands verified pairs need: the least number, not below ``least``, of which
    MEET of the pairs of AUDIT_ALL sampled queries with all rows share one."""
    asked = reps.orderBy(F.xxhash64("i"), "i").limit(AUDIT_ALL).collect()
    if not asked:
        return least
    ids = np.array([r["i"] for r in asked])
    sig = np.array([(r["s0"], r["s1"]) for r in asked], np.int64).view(np.uint64)
    sketch = np.stack([np.frombuffer(r["sketch"], np.uint16) for r in asked])
    values, most = dense(sketch), 2 * least
    while True:
        bands = [band(t, bins) for t in range(most)]
        schema = pa.schema([("route", pa.int32()), ("n", pa.int64())])

        def work(batches):
            seen = np.zeros(len(bands) + 1, np.int64)
            for t in batches:
                if not t.num_rows:
                    continue
                other = np.asarray(t.column(0))
                q, m = _exact(sig, np.stack([np.asarray(t.column(1)), np.asarray(t.column(2))], axis=1).view(np.uint64), RADIUS)
                new = ids[q] != other[m]
                q, m = q[new], m[new]
                for at in range(0, len(q), 1 << 14):
                    x, y = q[at : at + (1 << 14)], m[at : at + (1 << 14)]
                    sk = sketches(t.column(3).take(pa.array(y)))
                    ok = jaccard(sketch[x], sk) >= LEAST_JACCARD
                    same = values[x[ok]] == dense(sk[ok])
                    shared = np.ones((len(same), len(bands) + 1), bool)  # the last: none
                    for r, b in enumerate(bands):
                        shared[:, r] = same[:, list(b)].all(axis=1)
                    seen += np.bincount(shared.argmax(axis=1), minlength=len(seen))
            yield record_batch(schema, [np.arange(len(seen), dtype=np.int32), seen])

        n = np.zeros(len(bands) + 1, np.int64)
        for r in reps.select("i", "s0", "s1", "sketch").mapInArrow(work, "route int, n long").groupBy("route").agg(F.sum("n").alias("n")).collect():
            n[r["route"]] = r["n"]
        enough = np.flatnonzero(np.cumsum(n[:-1]) >= MEET * n.sum())
        if len(enough):
            return max(least, int(enough[0]) + 1)
        most *= 2


# --- search within a shard ------------------------------------------------------------------


class Graph:
    """Navigable small world over 128-bit signatures, inserted in array order."""

    def __init__(self, sig: np.ndarray):
        self.sig = sig
        self.links = np.full((len(sig) + 1, DEGREE), -1, np.int32)  # the last row: no node
        self.entry = np.arange(min(ENTRIES, len(sig)))

    def build(self, beam: int = BEAM, radius: int | None = None):
        """Insert all rows; yields the pairs (later row, earlier row) within the radius."""
        sig, n = self.sig, len(self.sig)
        done = min(n, 64)
        d = gaps(sig[:done, None], sig[None, :done]).astype(np.int64)
        if radius is not None:
            yield np.nonzero(np.tril(d <= radius, -1))
        np.fill_diagonal(d, 1 << 20)
        near = np.argsort(d, axis=1, kind="stable")[:, : min(LONG, done - 1)]
        self.links[:done, : near.shape[1]] = near
        while done < n:
            to = min(n, done + min(done, 1024))
            ids, dist = self.search(sig[done:to], beam, done)
            self._insert(np.arange(done, to), ids[:, :NEAREST], dist[:, :NEAREST])
            if radius is not None:
                for q, m in self._within(sig[done:to], ids, dist, radius, done):
                    yield q + done, m
                q, m = np.nonzero(np.tril(gaps(sig[done:to, None], sig[None, done:to]) <= radius, -1))
                yield q + done, m + done
            done = to

    def near(self, queries: np.ndarray, radius: int, beam: int = BEAM):
        """Pairs (query, row) within the radius, in parts."""
        for at in range(0, len(queries), 4096):
            q = queries[at : at + 4096]
            for x, m in self._within(q, *self.search(q, beam, len(self.sig)), radius, len(self.sig)):
                yield x + at, m

    def _within(self, queries: np.ndarray, ids: np.ndarray, dist: np.ndarray, radius: int, ready: int):
        """Pairs within the radius; beams wholly within it are doubled and searched on."""
        beam = ids.shape[1]
        full = np.flatnonzero(dist[:, -1] <= radius) if beam < ready else np.zeros(0, np.int64)
        part = np.ones(len(ids), bool)
        part[full] = False
        q, c = np.nonzero((dist <= radius) & part[:, None])
        yield q, ids[q, c].astype(np.int64)
        step = max(1, (1 << 20) // (2 * beam))
        for at in range(0, len(full), step):
            some = full[at : at + step]
            if 2 * beam >= ready // 8:
                for a in range(0, len(some), max(1, (4 << 20) // ready)):
                    s = some[a : a + max(1, (4 << 20) // ready)]
                    x, m = np.nonzero(gaps(queries[s, None], self.sig[None, :ready]) <= radius)
                    yield s[x], m
            else:
                for x, m in self._within(queries[some], *self.search(queries[some], 2 * beam, ready), radius, ready):
                    yield some[x], m

    def _insert(self, new: np.ndarray, near: np.ndarray, dist: np.ndarray) -> None:
        """Link new nodes with their nearest; a full list keeps its oldest LONG links,
        which span the space, and the nearest of the others."""
        self.links[new, : near.shape[1]] = near
        src, dst, d = np.repeat(new, near.shape[1]), near.ravel(), dist.ravel()
        ok = dst >= 0
        src, dst, d = src[ok], dst[ok], d[ok]
        order = np.lexsort((d, dst))
        src, dst = src[order], dst[order]
        begin = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
        place = np.arange(len(dst)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(dst)]])))
        keep = place < DEGREE
        at = dst[begin]
        row = np.cumsum(np.concatenate([[True], dst[1:] != dst[:-1]])) - 1
        extra = np.full((len(at), DEGREE), -1, np.int32)
        extra[row[keep], place[keep]] = src[keep]
        rest = np.concatenate([self.links[at][:, LONG:], extra], axis=1)
        gap = gaps(self.sig[rest], self.sig[at][:, None]).astype(np.int32)
        gap[rest < 0] = 1 << 20
        best = np.argsort(gap, axis=1)[:, : DEGREE - LONG]
        self.links[at, LONG:] = np.take_along_axis(rest, best, axis=1)

    def search(self, queries: np.ndarray, beam: int, ready: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the beams, nearest first (-1 where a beam isn't full)."""
        beam = min(beam, ready)
        step = max(16, min(4096, (32 << 20) // (ready + 1), (4 << 20) // beam))
        parts = [self._search(queries[at : at + step], beam, ready) for at in range(0, len(queries), step)]
        if len(parts) == 1:
            return parts[0]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, queries: np.ndarray, beam: int, ready: int) -> tuple[np.ndarray, np.ndarray]:
        entry = self.entry[self.entry < ready]
        d = gaps(self.sig[entry][None, :], queries[:, None]).astype(np.uint64)
        key = (d << _D) | (entry.astype(np.uint64) << _ONE)[None, :] | _ONE
        state = np.full((len(queries), max(beam, len(entry))), _NONE)
        state[:, : len(entry)] = key
        state.sort(axis=1)
        state = np.ascontiguousarray(state[:, :beam])
        visited = np.zeros((len(queries), ready + 1), bool)
        visited[:, entry] = True
        visited[:, ready] = True
        live, s = np.arange(len(queries)), state
        while True:
            open_ = (s & _ONE).astype(bool)
            has = open_.any(axis=1)
            if not has.all():
                state[live[~has]] = s[~has]
                live, s, open_ = live[has], s[has], open_[has]
            if not len(live):
                break
            rank = open_.cumsum(axis=1, dtype=np.int16)
            r, c = np.nonzero(open_ & (rank <= EXPAND))
            node = np.full((len(live), EXPAND), -1, np.int64)
            node[r, rank[r, c] - 1] = (s[r, c] & _ID) >> _ONE
            s[r, c] &= ~_ONE
            near = self.links[node].reshape(len(live), -1)
            near[(near < 0) | (near >= ready)] = ready
            flat = (live * (ready + 1))[:, None] + near
            seen = visited.reshape(-1)
            x, y = np.nonzero(~seen[flat])
            seen[flat[x, y]] = True
            to = near[x, y]
            d = gaps(self.sig[to], queries[live[x]]).astype(np.uint64)
            fresh = np.full(near.shape, _NONE)
            fresh[x, y] = (d << _D) | (to.astype(np.uint64) << _ONE) | _ONE
            both = np.concatenate([s, fresh], axis=1)
            both.sort(axis=1)
            same = both[:, 1:] == both[:, :-1]  # reached from two nodes at once
            both[:, 1:][same] = _NONE
            s = both[:, :beam].copy()
        state.sort(axis=1)
        ids, dist = ((state & _ID) >> _ONE).astype(np.int64), (state >> _D).astype(np.int64)
        ids[state == _NONE], dist[state == _NONE] = -1, 1 << 20
        return ids, dist


def _exact(queries: np.ndarray, sig: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and member numbers of all pairs within the radius."""
    q, m = [], []
    step = max(1, (4 << 20) // max(len(sig), 1))
    for at in range(0, len(queries), step):
        x, y = np.nonzero(gaps(queries[at : at + step, None], sig[None, :]) <= radius)
        q.append(x + at)
        m.append(y)
    return (np.concatenate(q), np.concatenate(m)) if q else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member number of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return label
        label = new


class Verified:
    """Takes pairs of a shard's rows in parts; keeps spanning stars and numbers of links."""

    def __init__(self, ids: np.ndarray, sketch: np.ndarray, met: list[tuple[int, ...]]):
        self.ids, self.sketch, self.met = ids, sketch, met
        self.order = np.argsort(ids, kind="stable")
        self.rank = np.empty(len(ids), np.int64)
        self.rank[self.order] = np.arange(len(ids))
        self.root, self.links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        self.values = None

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), 1 << 20):
            self._add(a[at : at + (1 << 20)], b[at : at + (1 << 20)])

    def _add(self, a: np.ndarray, b: np.ndarray) -> None:
        ok = self.ids[a] != self.ids[b]
        a, b = a[ok], b[ok]
        ok = alike(self.sketch, a, b)
        a, b = a[ok], b[ok]
        if not len(a):
            return
        self.root = _stars(len(self.root), self.root[self.rank[a]], self.root[self.rank[b]])[self.root]
        if self.met and self.values is None:
            self.values = dense(self.sketch)
        new = np.ones(len(a), bool)
        for bins in self.met:
            new &= ~np.logical_and.reduce([self.values[a, k] == self.values[b, k] for k in bins])
        self.links += np.bincount(a[new], minlength=len(self.ids)) + np.bincount(b[new], minlength=len(self.ids))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges (row id, smaller id), and ids with their links."""
        sorted_ = self.ids[self.order]
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        linked = np.flatnonzero(self.links)
        return sorted_[moved], sorted_[self.root[moved]], self.ids[linked], self.links[linked]


def search_shard(sig: np.ndarray, ids: np.ndarray, member: np.ndarray, make) -> tuple[Verified, int, int]:
    """Verified pairs of members with each other and of the other rows with members, and the
    pairs that the audit wanted and got (0 of 0 where the shard was scanned)."""
    order = np.argsort(mix64(ids.view(np.uint64)), kind="stable")  # insertion in hash order
    inside, outside = order[member[order]], order[~member[order]]
    mine = sig[inside]

    def scan():
        found = make()
        q, m = _exact(mine, mine, RADIUS)
        later = q > m
        found.add(inside[q[later]], inside[m[later]])
        for at in range(0, len(outside), 4096):
            q, m = _exact(sig[outside[at : at + 4096]], mine, RADIUS)
            found.add(outside[q + at], inside[m])
        return found

    if len(inside) <= EXACT_ROWS:
        return scan(), 0, 0
    probe = np.unique(np.linspace(0, len(inside) - 1, AUDIT).astype(np.int64))
    q, m = _exact(mine[probe], mine, RADIUS)
    n = len(inside)
    pair = lambda a, b: np.maximum(a, b) * n + np.minimum(a, b)
    want = np.unique(pair(probe[q], m)[probe[q] != m])
    ask = np.unique(np.linspace(0, len(outside) - 1, min(AUDIT, len(outside))).astype(np.int64))
    q, m = _exact(sig[outside[ask]], mine, RADIUS)
    want_out = ask[q] * n + m
    beam = BEAM
    for _ in range(3):
        graph, found, got, got_out = Graph(mine), make(), [], []
        for a, b in graph.build(beam, RADIUS):
            found.add(inside[a], inside[b])
            some = np.isin(a, probe) | np.isin(b, probe)
            got.append(pair(a[some], b[some]))
        for a, b in graph.near(sig[outside], RADIUS, beam):
            found.add(outside[a], inside[b])
            some = np.isin(a, ask)
            got_out.append(a[some] * n + b[some])
        have = np.isin(want, np.concatenate(got)).sum() + (np.isin(want_out, np.concatenate(got_out)).sum() if got_out else 0)
        wanted = len(want) + len(want_out)
        if have >= LEAST_RECALL * wanted:
            return found, wanted, int(have)
        beam *= 2
    return scan(), 0, 0


def small_shards(sig: np.ndarray, ids: np.ndarray, sketch: np.ndarray, shard: np.ndarray, met) -> Verified:
    """Exact pairs of many small shards (rows sorted by shard number) at once: each row is
    compared with the next ones of its shard, one step after another."""
    found = Verified(ids, sketch, met)
    a = np.arange(len(sig))
    for k in range(1, len(sig)):
        a = a[a + k < len(sig)]
        a = a[shard[a] == shard[a + k]]
        if not len(a):
            break
        near = a[gaps(sig[a], sig[a + k]) <= RADIUS]
        if len(near):
            found.add(near, near + k)
    return found


# --- the whole corpus -----------------------------------------------------------------------

_ROUTED = "bucket long, path string, i long, s0 long, s1 long, sketch binary"


def routed(reps: DataFrame, bins: int, routes: int) -> DataFrame:
    """A row for each band of each document."""
    schema = pa.schema([("k", pa.list_(pa.int64())), ("i", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), ("sketch", pa.binary())])

    def work(batches):
        for t in batches:
            if t.num_rows:
                values = dense(sketches(t.column(3)))
                keys = np.stack([band_key(values, band(r, bins), r) for r in range(routes)], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * routes), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([lists, *(t.column(c) for c in range(4))], schema=schema)

    rows = reps.select("i", "s0", "s1", "sketch").mapInArrow(work, "k array<long>, i long, s0 long, s1 long, sketch binary")
    return rows.select(F.posexplode("k").alias("p", "bucket"), "i", "s0", "s1", "sketch").select("bucket", F.col("p").cast("string").alias("path"), "i", "s0", "s1", "sketch")


def banded_again(rows: DataFrame, level: int) -> DataFrame:
    """Sub-bands of hot shards: one bin more, in as many sub-bands as a pair needs to meet."""
    names = [c.split()[0] for c in _ROUTED.split(", ")]
    schema = pa.schema([("bucket", pa.int64()), ("path", pa.string()), ("i", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), ("sketch", pa.binary())])

    def work(batches):
        for t in batches:
            if t.num_rows:
                values, bucket = dense(sketches(t.column(5))), np.asarray(t.column(0)).view(np.uint64)
                for k in range(routes_for(1)):
                    path = pa.compute.binary_join_element_wise(t.column(1).cast(pa.string()), pa.scalar(str(k)), ".")
                    key = band_key(values, (sub_bin(level, k),), mix64(bucket + np.uint64(k)))
                    yield record_batch(schema, [key, path, *(t.column(c) for c in range(2, 6))])

    return rows.select(*names).mapInArrow(work, _ROUTED)


def placed(reps: DataFrame, bins: int, routes: int, rows: int) -> DataFrame:
    """Rows with shard (bucket, part) and whether they are members or only query there. Every
    pair of a bucket meets in one part: that of the row with the smaller part number."""
    now, ready = routed(reps, bins, routes), None
    for level in range(LEVELS + 1):
        counts = now.groupBy("bucket").count()
        hot = materialize(counts.where(F.col("count") > HOT_ROWS).select("bucket"), "hot") if level < LEVELS else None
        if hot is None or not (n := hot.count()):
            ready = now if ready is None else ready.union(now)
            break
        hot = bounded_broadcast(hot, n, 8)
        cold = now.join(hot, "bucket", "left_anti").select(now.columns)
        ready = cold if ready is None else ready.union(cold)
        now = banded_again(now.join(hot, "bucket", "left_semi"), level)
    counts = ready.groupBy("bucket").count().where(F.col("count") > 4 * SHARD_ROWS)
    parts = materialize(counts.select("bucket", F.ceil(F.col("count") / (2 * SHARD_ROWS)).cast("int").alias("parts")), "parts")
    if not (n := parts.count()):
        return ready.withColumn("part", F.lit(0)).withColumn("member", F.lit(True))
    ready = ready.join(bounded_broadcast(parts, n, 12), "bucket", "left")
    home = F.pmod(F.xxhash64("i"), F.coalesce("parts", F.lit(1))).cast("int")
    ready = ready.withColumn("home", home).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("home"))))
    return ready.withColumn("member", F.col("home") == F.col("part"))


def found_in_shards(reps: DataFrame, rows: int) -> DataFrame:
    """(kind, u, v): verified edges ("edge", u > v), links ("link", id, number) and audits
    ("audit", pairs wanted, pairs got) of all shards of reps (i, s0, s1, sketch)."""
    means = mean_shards(reps, 8)
    bins = next((r for r, m in enumerate(means, 1) if m <= SHARD_ROWS), len(means))
    routes = audited_routes(reps, bins, routes_for(bins))
    schema = pa.schema([("kind", pa.string()), ("u", pa.int64()), ("v", pa.int64())])

    def told(found: Verified, audit=(0, 0)):
        u, v, x, n = found.result()
        kinds = ["edge"] * len(u) + ["link"] * len(x) + ["audit"] * bool(audit[0])
        extra = audit[:1] if audit[0] else (), audit[1:] if audit[0] else ()
        return record_batch(schema, [pa.array(kinds, pa.string()), np.concatenate([u, x, extra[0]]).astype(np.int64), np.concatenate([v, n, extra[1]]).astype(np.int64)])

    def shards(t: pa.Table):
        bucket, part, ids = (t.column(c).to_numpy() for c in ("bucket", "part", "i"))
        sig = np.ascontiguousarray(np.stack([t.column(c).to_numpy() for c in ("s0", "s1")], axis=1)).view(np.uint64)
        member = t.column("member").to_numpy()
        number = np.cumsum(np.concatenate([[False], (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])]))
        size = np.bincount(number)
        begin = np.cumsum(size) - size
        path = t.column("path").to_pylist()
        # a row alone in its shard has nobody to meet
        few = np.flatnonzero((size > 1) & (size <= SHIFTS) & np.logical_and.reduceat(member, begin))
        by_path: dict[str, list[int]] = {}
        for s in few.tolist():
            by_path.setdefault(path[begin[s]], []).append(s)
        for p, some in by_path.items():
            at = np.concatenate([np.arange(begin[s], begin[s] + size[s]) for s in some])
            yield told(small_shards(sig[at], ids[at], sketches(t.column("sketch").take(pa.array(at))), number[at], earlier(p, bins)))
        for s in np.setdiff1d(np.flatnonzero(size > 1), few).tolist():
            at = slice(int(begin[s]), int(begin[s] + size[s]))
            sketch = sketches(t.column("sketch").slice(at.start, size[s]))
            found, *audit = search_shard(sig[at], ids[at], member[at], lambda: Verified(ids[at], sketch, earlier(path[at.start], bins)))  # noqa: B023
            yield told(found, audit)

    def work(batches):
        held, n = [], 0  # whole shards, some ten thousand rows together
        for b in batches:
            if not b.num_rows:
                continue
            key = lambda x, r: (x.column(0)[r].as_py(), x.column(1)[r].as_py())
            if n >= 65_536:
                last = key(held[-1], held[-1].num_rows - 1)
                same = (np.asarray(b.column(0)) == last[0]) & (np.asarray(b.column(1)) == last[1])
                cut = int(same.argmin()) if not same.all() else b.num_rows
                if cut < b.num_rows:
                    yield from shards(pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks())
                    held, n, b = [], 0, b.slice(cut)
            held.append(b)
            n += b.num_rows
        if held:
            yield from shards(pa.Table.from_batches(held).combine_chunks())

    rows_ = placed(reps, bins, routes, rows).select("bucket", "part", "path", "i", "s0", "s1", "sketch", "member")
    return rows_.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(work, "kind string, u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(i, root): every vertex but the roots with the smallest vertex of its component.

    Large-star and small-star steps; a vertex's least neighbour is an aggregate with map-side
    combine, joined back, so a hot vertex's edges may be split. Each round's edges are written
    to the shared folder, and rounds end when the edges no longer change."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("u").alias("i"), F.col("v").alias("root"))
        seen = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large")
        low = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = low.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = materialize(small.where("u <> v").distinct(), "edges")


def represented(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(i, s0, s1, sketch) of each different description, under its smallest doc_id, (i, rep)
    of every document and description, and the number of descriptions."""
    described = materialize(signatures(docs), "signatures")
    reps = materialize(described.groupBy("s0", "s1", "sketch").agg(F.min("i").alias("i")), "representatives")
    h = F.xxhash64("sketch").alias("h")
    member = described.select("i", "s0", "s1", h).join(reps.select("s0", "s1", h, F.col("i").alias("rep")), ["s0", "s1", "h"])
    return reps, materialize(member.select("i", "rep").distinct(), "members"), reps.count()


def searched(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Descriptions, members and what their shards found."""
    reps, members, rows = represented(docs)
    return reps, members, materialize(found_in_shards(reps, rows), "found")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id, links) of every document that a smaller one of its group, the
    group's number, stands for; a document without a row represents itself."""
    return _classes(*searched(docs)[1:])


def _classes(members: DataFrame, found: DataFrame) -> DataFrame:
    first = members.groupBy("i").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    # a doc_id with several texts ties their descriptions together
    tied = members.join(first.where("rep <> last").select("i", F.col("rep").alias("first")), "i").select(F.col("rep").alias("u"), F.col("first").alias("v"))
    edges = found.where("kind = 'edge'").select("u", "v").union(tied)
    roots = components(edges).select(F.col("i").alias("rep"), "root")
    links = found.where("kind = 'link'").groupBy(F.col("u").alias("rep")).agg(F.sum("v").alias("links"))
    rows = first.select("i", "rep").join(roots, "rep", "left").join(links, "rep", "left")
    rows = rows.select(F.col("i").alias("doc_id"), F.coalesce("root", "rep").alias("kept_doc_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return rows.where("doc_id <> kept_doc_id")


def shard_audits(docs: DataFrame) -> DataFrame:
    """(wanted, got) pairs of the audit of every shard that has a graph."""
    return searched(docs)[2].where("kind = 'audit'").select(F.col("u").alias("wanted"), F.col("v").alias("got"))


def measured_recall(docs: DataFrame, queries: int = 2000) -> tuple[int, int]:
    """Verified pairs of sampled queries with all documents, by an exact scan, and how many of
    them near_duplicates puts into one group."""
    reps, members, found = searched(docs)
    root = {r["doc_id"]: r["kept_doc_id"] for r in _classes(members, found).collect()}
    asked = reps.orderBy(F.xxhash64("i", F.lit(1)), "i").limit(queries).collect()
    if not asked:
        return 0, 0
    ids = np.array([r["i"] for r in asked])
    sig = np.array([(r["s0"], r["s1"]) for r in asked], np.int64).view(np.uint64)
    sketch = np.stack([np.frombuffer(r["sketch"], np.uint16) for r in asked])
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def work(batches):
        for t in batches:
            if t.num_rows:
                other = np.asarray(t.column(0))
                q, m = _exact(sig, np.stack([np.asarray(t.column(1)), np.asarray(t.column(2))], axis=1).view(np.uint64), RADIUS)
                ok = (ids[q] != other[m]) & (jaccard(sketch[q], sketches(t.column(3).take(pa.array(m)))) >= LEAST_JACCARD)
                yield record_batch(schema, [ids[q[ok]], other[m[ok]]])

    pairs = reps.select("i", "s0", "s1", "sketch").mapInArrow(work, "u long, v long").collect()
    return len(pairs), sum(root.get(p["u"], p["u"]) == root.get(p["v"], p["v"]) for p in pairs)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each group left, all columns kept. Texts are shuffled only
    where the dropped ids are too many to broadcast."""
    gone = materialize(near_duplicates(docs).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    gone = bounded_broadcast(gone, gone.count(), 8)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
