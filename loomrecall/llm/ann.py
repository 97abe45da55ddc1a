"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors pass three rounds of random signs and fast Hadamard transform (a pseudo-
rotation) and hash to the nearest signed axis. A table's code joins ``n_hashes`` such
axes, the last of a rotation cut to ``last_dim`` coordinates, so that buckets hold about
``BUCKET`` vectors whatever the size of the table. Each vector is stored under its own
code in ``TABLES`` tables. Queries are the rows whose id is divisible by ``EVERY``; each asks
for the codes that lose least against it: ``PROBES`` at least, and as many as ``AUDIT``
sampled vectors need to meet ``RECALL`` of their exact neighbours, which are found over the
whole table. The number so follows the table.
Buckets' candidates are scored exactly (cosine, double precision), and each query keeps
the best ``k`` over all buckets, without a cap on candidates.

Neighbouring codes of a table form groups of about ``SHARD`` vectors, and a query
travels once to each group it probes, with the list of its codes there; so what is shuffled
is ``TABLES`` copies of the table and the queries' visits. A group that
holds more is split into shards, all of which its queries visit, so hot buckets spread
over tasks and lose nothing.

Defined results: a null, empty, zero or non-finite vector, or one of another length
than the table's most frequent, is no candidate and has no neighbours; rows without an
id are left out; rows with the same id are one vector (the largest by value, also where they differ); ties go to
the smaller id; fewer than k candidates give fewer rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialize, record_batch

K = 10
TABLES = 4
PROBES = 32
BUCKET = 128
SHARD = 16384
SEED = 5
EVERY = 50
AUDIT = 256
RECALL = 0.95


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class Hasher:
    def __init__(self, dim: int, n_hashes: int, last_dim: int, tables: int = TABLES, seed: int = SEED):
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.n_hashes, self.last_dim, self.tables = n_hashes, last_dim, tables
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, n_hashes, 3, self.width))

    def axes(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """Rotated coordinates of each of a table's hashes."""
        wide = np.zeros((len(x), self.width))
        wide[:, : x.shape[1]] = x
        out = []
        for j in range(self.n_hashes):
            y = wide
            for s in self.signs[table, j]:
                y = hadamard(y * s)
            out.append(y[:, : self.last_dim] if j == self.n_hashes - 1 else y)
        return out

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """(rows, n) codes, each vector's own first, then by what the changed axes lose."""
        codes, losses = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for y in self.axes(x, table):
            d = y.shape[1]
            score = np.concatenate([y, -y], axis=1)
            m = min(n, 2 * d)
            top = np.argsort(-score, axis=1, kind="stable")[:, :m]
            value = np.take_along_axis(score, top, axis=1)
            loss = value[:, :1] ** 2 - np.sign(value) * value**2
            codes = (codes[:, :, None] * (2 * d) + top[:, None, :]).reshape(len(x), -1)
            losses = (losses[:, :, None] + loss[:, None, :]).reshape(len(x), -1)
            best = np.argsort(losses, axis=1, kind="stable")[:, :n]
            codes, losses = np.take_along_axis(codes, best, axis=1), np.take_along_axis(losses, best, axis=1)
        return codes


def plan(rows: int, dim: int, bucket: int = BUCKET) -> tuple[int, int]:
    """(hashes, coordinates of the last) for buckets of about ``bucket`` rows."""
    width = 1 << max(1, (dim - 1).bit_length())
    want, hashes = max(2.0, rows / bucket), 1
    while want > 2 * width:
        want /= 2 * width
        hashes += 1
    last = 1 << max(0, int(np.ceil(np.log2(want / 2))))
    return hashes, int(min(width, max(1, last)))


def _best(q: np.ndarray, m: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best (score, then smaller id) of each query."""
    order = np.lexsort((m, -s, q))
    qo = q[order]
    begin = np.flatnonzero(np.concatenate([[True], qo[1:] != qo[:-1]])) if len(qo) else np.zeros(0, np.int64)
    place = np.arange(len(qo)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(qo)]])))
    return order[place < k]


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float32).reshape(len(column), dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def enough_probes(v: DataFrame, hasher: Hasher, dim: int, k: int, least: int, space: int) -> int:
    """Probes, ``least`` at least, with which AUDIT sampled rows of v (i, v) meet RECALL of
    their k exact neighbours; the sample is compared with all rows."""
    if least >= space or k < 1:
        return least
    asked = v.orderBy(F.xxhash64("i"), "i").limit(AUDIT).collect()
    ids = np.array([r["i"] for r in asked])
    x = _unit(pa.array([r["v"] for r in asked], pa.list_(pa.float32())), dim)
    schema = pa.schema([("q", pa.int32()), ("i", pa.int64()), ("s", pa.float64()), ("v", pa.list_(pa.float32()))])

    def work(batches):
        have = None
        for b in batches:
            if not b.num_rows:
                continue
            other = np.asarray(b.column(0))
            s = np.round(x @ _unit(b.column(1), dim).T, 9)
            q, m = np.nonzero(ids[:, None] != other[None, :])
            best = _best(q, other[m], s[q, m], k)
            t = pa.table([pa.array(q[best].astype(np.int32)), pa.array(other[m[best]]), pa.array(s[q[best], m[best]]), b.column(1).take(pa.array(m[best])).cast(pa.list_(pa.float32()))], names=schema.names)
            t = t if have is None else pa.concat_tables([have, t])
            have = t.take(pa.array(_best(*(t.column(c).to_numpy() for c in range(3)), k)))
        if have is not None:
            yield from have.cast(schema).combine_chunks().to_batches()

    found = v.mapInArrow(work, "q int, i long, s double, v array<float>")
    order = Window.partitionBy("q").orderBy(F.desc("s"), "i")
    true = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("q", "v").collect()  # AUDIT * k rows
    if not true:
        return least
    q = np.array([r["q"] for r in true])
    y = _unit(pa.array([r["v"] for r in true], pa.list_(pa.float32())), dim)
    own = [hasher.probes(y, t, 1)[:, 0] for t in range(hasher.tables)]
    n = least
    while n < space:
        n = min(space, 2 * n)
        place = np.full(len(q), n)
        step = max(1, (1 << 15) // n)
        for at in range(0, len(x), step):
            mine = np.flatnonzero((q >= at) & (q < at + step))
            for t in range(hasher.tables):
                same = hasher.probes(x[at : at + step], t, n)[q[mine] - at] == own[t][mine, None]
                place[mine] = np.minimum(place[mine], np.where(same.any(axis=1), same.argmax(axis=1), n))
        want = np.sort(place)[int(np.ceil(RECALL * len(q))) - 1]
        if want < n:
            return max(least, int(want) + 1)
    return n


def measured_recall(vectors: DataFrame, found: DataFrame, k: int = K, every: int = EVERY) -> float:
    """Share of the exact k nearest, over all rows, that ``found`` holds; for tables of vectors of
    one length that brute force can take."""
    v = vectors.select(vectors["vec_id"].cast("long").alias("i"), vectors["embedding"].cast("array<double>").alias("v"))
    q = v.where(F.pmod("i", F.lit(every)) == 0).collect()
    ids, x = np.array([r["i"] for r in q]), np.array([r["v"] for r in q])
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def work(batches):
        for b in batches:
            other = np.asarray(b.column(0))
            s = np.round(x @ _unit(b.column(1), x.shape[1]).T, 9)
            a, m = np.nonzero(ids[:, None] != other[None, :])
            best = _best(a, other[m], s[a, m], k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[best]]), pa.array(other[m[best]]), pa.array(s[a[best], m[best]])], names=["query_id", "neighbor_id", "s"])

    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "neighbor_id")
    best = v.mapInArrow(work, "query_id long, neighbor_id long, s double").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return best.join(found, ["query_id", "neighbor_id"], "left_semi").count() / max(1, best.count())


def nearest(vectors: DataFrame, k: int = K, tables: int = TABLES, probes: int = PROBES, bucket: int = BUCKET, every: int = EVERY, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, neighbor_id, rank, cosine): the k nearest others, of all rows, found for every
    vector whose id is divisible by ``every`` (1: for every vector)."""
    v = vectors.select(vectors[id_column].cast("long").alias("i"), vectors[vector_column].cast("array<float>").alias("v"))
    v = v.where("i is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) <= 3.4e38)")
    v = materialize(v.groupBy("i").agg(F.max("v").alias("v")).where("exists(v, x -> x <> 0)"), "vectors")
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, neighbor_id long, rank int, cosine double")
    dim, rows = sizes["d"], sizes["count"]
    hashes, last = plan(rows, dim, bucket)
    schema = pa.schema([("b", pa.int64()), ("i", pa.int64()), ("own", pa.int64()), ("codes", pa.binary()), ("v", pa.binary())])
    space = (2 * (1 << max(1, (dim - 1).bit_length()))) ** (hashes - 1) * 2 * last
    groups = min(space, -(-rows // SHARD))
    span = -(-space // groups)
    sized = v.where(F.size("v") == dim)
    probes = enough_probes(sized, Hasher(dim, hashes, last, tables), dim, k, probes, space)

    def route(batches):
        hasher = Hasher(dim, hashes, last, tables)
        for b in batches:
            ids = np.asarray(b.column(0))
            x = np.asarray(b.column(1).flatten(), np.float32).reshape(len(ids), dim)
            packed = np.array([r.tobytes() for r in x], object)
            unit = x.astype(np.float64)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            for t in range(tables):
                own = hasher.probes(unit, t, 1)[:, 0]
                yield record_batch(schema, [own // span + t * groups, ids, own, pa.array([b""] * len(ids), pa.binary()), pa.array(packed, pa.binary())])
                asks = np.flatnonzero(ids % every == 0)
                if not len(asks):
                    continue
                codes = hasher.probes(unit[asks], t, probes)
                n = codes.shape[1]
                row, flat = np.repeat(np.arange(len(asks)), n), codes.ravel()
                order = np.lexsort((flat, row))
                row, flat = row[order], flat[order]
                group = flat // span
                begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (group[1:] != group[:-1])]))
                edge = np.concatenate([begin, [len(flat)]]) * 8
                buffer = flat.tobytes()
                lists = [buffer[a:z] for a, z in zip(edge[:-1].tolist(), edge[1:].tolist())]
                r = asks[row[begin]]
                yield record_batch(schema, [group[begin] + t * groups, ids[r], np.full(len(r), -1), pa.array(lists, pa.binary()), pa.array(packed[r], pa.binary())])

    routed = sized.mapInArrow(route, "b long, i long, own long, codes binary, v binary")
    if groups > 1:
        counts = routed.where("own >= 0").groupBy("b").count().select("b", F.ceil(F.col("count") / (2 * SHARD)).cast("int").alias("shards"))
        # probes of groups that hold nothing end here
        routed = routed.join(bounded_broadcast(counts, tables * groups, 24), "b")
        # a stored row goes to one shard of its group, a query to all
        home = F.pmod(F.xxhash64("i"), "shards").cast("int")
        every_shard = F.sequence(F.lit(0), F.col("shards") - 1)
        routed = routed.withColumn("s", F.explode(F.when(F.col("own") >= 0, F.array(home)).otherwise(every_shard)))
    else:
        routed = routed.withColumn("s", F.lit(0))

    def score(t: pa.Table) -> pa.Table:
        ids, own = t.column("i").to_numpy(), t.column("own").to_numpy()
        x = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float32).reshape(len(ids), dim)

        def unit(rows):
            y = x[rows].astype(np.float64)
            return y / np.linalg.norm(y, axis=1, keepdims=True)

        lists = t.column("codes").to_pylist()
        code = np.frombuffer(b"".join(lists), np.int64)
        asks = np.repeat(np.arange(len(ids)), [len(c) // 8 for c in lists])
        by = np.argsort(code, kind="stable")
        code, asks = code[by], asks[by]
        held = np.flatnonzero(own >= 0)
        held = held[np.argsort(own[held], kind="stable")]
        values, begin, size = np.unique(own[held], return_index=True, return_counts=True)
        parts = []
        for c, a, n in zip(values.tolist(), begin.tolist(), size.tolist()):
            m = held[a : a + n]
            ask = asks[np.searchsorted(code, c) : np.searchsorted(code, c, side="right")]
            stored = unit(m) if len(ask) else None
            for at in range(0, len(ask), 2048):
                q = ask[at : at + 2048]
                s = unit(q) @ stored.T
                if n > k + 1:  # all that tie with the last are kept
                    edge = np.partition(s, n - k - 1, axis=1)[:, n - k - 1 : n - k]
                    r, col = np.nonzero(s >= edge)
                else:
                    r, col = np.divmod(np.arange(s.size), n)
                parts.append((q[r], m[col], s[r, col]))
        if not parts:
            return pa.table({"query_id": pa.array([], pa.int64()), "neighbor_id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        q, m, c = (np.concatenate(p) for p in zip(*parts))
        q, m = ids[q], ids[m]
        other = q != m
        q, m, c = q[other], m[other], c[other]
        best = _best(q, m, np.round(c, 9), k)
        return pa.table({"query_id": q[best], "neighbor_id": m[best], "cosine": c[best]})

    found = routed.groupBy("b", "s").applyInArrow(score, "query_id long, neighbor_id long, cosine double")
    # a pair's score may differ in its last digits between buckets
    found = found.groupBy("query_id", "neighbor_id").agg(F.max(F.round("cosine", 9)).alias("cosine"))
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "neighbor_id", "rank", "cosine")
