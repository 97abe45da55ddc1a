"""Exact nearest neighbours in blocks: every pair is scored, none is collected.

Queries and records are cut into blocks by hash, and each pair of blocks is scanned tile by
tile; of every query the k best so far are kept, and a second, small shuffle ranks those of
the record blocks. Block sizes are fixed, so memory per task doesn't depend on the tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import top_k

#: Most bytes of a record block (a query block has half of it), and pairs of blocks that keep a cluster busy.
BLOCK_BYTES, TASKS = 64 << 20, 64
#: Rows and columns of a tile: its scores stay in a core's cache.
ROWS, COLUMNS = 512, 4096
METRICS = ("cosine", "dot_product", "euclidean")


def matrix(column: pa.Array, what: str = "vector") -> np.ndarray:
    """Rows of a list column. A null, an empty or non-finite vector and one of another length
    are errors: they would shift all rows that follow."""
    if column.null_count:
        raise ValueError(f"{column.null_count} {what}s are null")
    sizes = np.asarray(pa.compute.list_value_length(column))
    if len(sizes) and (sizes.min() != sizes.max() or sizes[0] == 0):
        raise ValueError(f"{what}s of {sizes.min()} to {sizes.max()} numbers")
    flat = column.flatten()
    x = np.asarray(flat)
    if flat.null_count or (x.dtype.kind == "f" and not np.isfinite(x).all()):
        raise ValueError(f"a {what} holds a null or non-finite number")
    return x.reshape(len(column), -1)


def _scores(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    s = q @ d.T
    if metric == "dot_product":
        return s
    qq, dd = (q * q).sum(axis=1), (d * d).sum(axis=1)
    if metric == "euclidean":
        return -np.maximum(qq[:, None] + dd[None, :] - 2 * s, 0)
    n = np.sqrt(qq)[:, None] * np.sqrt(dd)[None, :]
    return np.divide(s, n, out=np.zeros_like(s), where=n > 0)


def grid(n_d: int, n_q: int, row_bytes: int) -> tuple[int, int]:
    """Number of record blocks and of query blocks. Record blocks are as large as memory allows,
    for each of them returns k rows a query; query blocks give the parallelism."""
    most = max(BLOCK_BYTES // max(row_bytes, 1), 2048)
    nd = max(-(-n_d // most), 1)
    return nd, max(-(-n_q // (most // 2)), min(-(-TASKS // nd), -(-n_q // 256)), 1)


def blocks(df: DataFrame, name: str, own: int, copies: int) -> DataFrame:
    """Rows with a block of their own by hash of id, repeated for every block of the other side."""
    other = "qb" if name == "db" else "db"
    return df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def block_pairs(d: DataFrame, q: DataFrame, nd: int, nq: int):
    """Every pair of blocks as a group; more partitions than groups, so that few share one."""
    both = blocks(d, "db", nd, nq).unionByName(blocks(q, "qb", nq, nd))
    return both.repartition(2 * nd * nq, "qb", "db").groupBy("qb", "db")


class Best:
    """k best of each row: higher scores first, then lower columns. If columns come in ascending
    order, one that only equals the k-th best is not added."""

    def __init__(self, rows: int, k: int, ordered: bool = True):
        self.rows, self.k, self.ordered = rows, k, ordered
        self.last = np.full(rows, np.iinfo(np.int64).max)
        self.edge = np.full(rows, -np.inf)
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, r: np.ndarray, c: np.ndarray, score: np.ndarray, raw: np.ndarray) -> None:
        ok = score > self.edge[r]
        if not self.ordered:
            ok |= (score == self.edge[r]) & (c < self.last[r])
        self.new.append((r[ok], c[ok], score[ok], raw[ok]))
        self.waiting += len(self.new[-1][0])
        if 2 * self.waiting >= self.rows * self.k:
            self.merge()

    def merge(self) -> None:
        r, c, s, raw = (np.concatenate(x) for x in zip(self.kept, *self.new))
        order = np.lexsort((c, -s, r))
        r = r[order]
        begin = np.searchsorted(r, np.arange(self.rows))
        place = np.arange(len(r)) - begin[r]
        last = order[place == self.k - 1]
        self.edge[r[place == self.k - 1]], self.last[r[place == self.k - 1]] = s[last], c[last]
        order = order[place < self.k]
        self.kept, self.new, self.waiting = (r[place < self.k], c[order], s[order], raw[order]), [], 0

    def result(self) -> tuple:
        """(rows, columns, scores), in order."""
        self.merge()
        return self.kept[0], self.kept[1], self.kept[3]


def hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a contiguous mask's few true cells; eight cells are looked at at once."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])
    return np.divmod(at, mask.shape[1])


def tiles(n: int, k: int):
    """Bounds of tiles: the first are small, to find an edge that most of what follows fails."""
    at, width = 0, max(256, 4 * k)
    while at < n:
        yield at, min(at + width, n)
        at, width = at + width, min(4 * width, COLUMNS)


def nearest_rows(q: np.ndarray, d: np.ndarray, q_ids: np.ndarray, d_ids: np.ndarray, k: int, metric: str, drop_self: bool) -> tuple:
    """(row of q, row of d, score) of the k best. d must be in the order of its ids. Pairs are
    sieved in single precision, with an allowance of more than its error; what passes is scored in
    double precision, so the result is that of double precision throughout."""
    qn, dn = np.sqrt((q * q).sum(axis=1)), np.sqrt((d * d).sum(axis=1))
    of = lambda x, n: x / np.where(n > 0, n, 1)[:, None]
    top = dn.max() if len(dn) and dn.max() > 0 else 1.0
    if metric == "cosine":
        a, b, unit, shift = of(q, qn), of(d, dn), np.ones(len(q)), 0.0
    elif metric == "dot_product":
        a, b, unit, shift = of(q, qn), d / top, np.where(qn > 0, qn, 1) * top, 0.0
    else:
        m = qn + top
        a = np.concatenate([2 * q / m[:, None], -(top / m)[:, None]], axis=1)
        b, unit, shift = np.concatenate([d / top, (dn / top)[:, None] ** 2], axis=1), m * top, qn * qn
    a, b = a.astype(np.float32), np.ascontiguousarray(b.astype(np.float32).T)
    slack = 4 * (q.shape[1] + 8) * 2.0**-23
    out = []
    for at in range(0, len(q), ROWS):
        x, best = q[at : at + ROWS], Best(len(q[at : at + ROWS]), k)
        u, h = unit[at : at + ROWS], shift if np.isscalar(shift) else shift[at : at + ROWS]
        for lo, hi in tiles(len(d), k):
            s = a[at : at + ROWS] @ b[:, lo:hi]
            r, c = hits(s >= ((best.edge + h) / u - slack).astype(np.float32)[:, None])
            if not len(r):
                continue
            if 8 * len(r) > s.size:
                raw = _scores(x, d[lo:hi], metric)[r, c]
            else:
                raw = np.concatenate([_pair_scores(x[r[i : i + 65536]], d[lo + c[i : i + 65536]], metric) for i in range(0, len(r), 65536)])
            c = c + lo
            if drop_self:
                other = q_ids[at + r] != d_ids[c]
                r, c, raw = r[other], c[other], raw[other]
            best.add(r, c, np.round(raw, 9), raw)
        r, c, raw = best.result()
        out.append((r + at, c, raw))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _pair_scores(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    s = np.einsum("ij,ij->i", q, d)
    if metric == "dot_product":
        return s
    qq, dd = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", d, d)
    if metric == "euclidean":
        return -np.maximum(qq + dd - 2 * s, 0)
    n = np.sqrt(qq) * np.sqrt(dd)
    return np.divide(s, n, out=np.zeros_like(s), where=n > 0)


def _sides(records: DataFrame, queries: DataFrame, *more) -> tuple[DataFrame, DataFrame, int, int]:
    """Both sides of a scan of vectors, and the numbers of their blocks. Floats stay floats until
    they are scored. more: columns of records and queries besides."""
    n_d, dim = records.agg(F.count("*"), F.max(F.size("vector"))).first()
    nd, nq = grid(n_d, queries.count(), 8 * max(dim or 1, 1))
    kind = "array<float>" if all(t.schema["vector"].dataType.simpleString() == "array<float>" for t in (records, queries)) else "array<double>"
    side = lambda t, stored: t.select("id", F.col("vector").cast(kind).alias("v"), *more, F.lit(stored).alias("stored"))
    return side(records, True), side(queries, False), nd, nq


def exact_topk(records: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", same_group: bool = False, drop_self: bool = False, zero_query_empty: bool = False) -> DataFrame:
    """(query_id, doc_id, rank, score) from records and queries (id, vector[, grp]).

    same_group: a record's grp must equal the query's (a metadata filter, applied before
    ranking). Zero vectors score 0; with zero_query_empty a zero query finds nothing."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if k <= 0:
        return records.sparkSession.createDataFrame([], "query_id long, doc_id long, rank int, score double")
    grp = F.col("grp").cast("string") if same_group else F.lit(0)
    d, q, nd, nq = _sides(records, queries, grp.alias("g"))

    def work(t: pa.Table) -> pa.Table:
        stored, ids = t.column("stored").to_numpy(), t.column("id").to_numpy()
        g = np.asarray(t.column("g").combine_chunks().dictionary_encode().indices.fill_null(-1))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if stored.any() and not stored.all():
            x = matrix(t.column("v").combine_chunks()).astype(np.float64, copy=False)
            d_, q_ = np.flatnonzero(stored), np.flatnonzero(~stored)
            if zero_query_empty:
                q_ = q_[(x[q_] ** 2).sum(axis=1) > 0]
            q_ = q_[g[q_] >= 0]  # as in SQL, a null grp equals none
            d_, q_ = d_[np.lexsort((ids[d_], g[d_]))], q_[np.argsort(g[q_], kind="stable")]
            groups, begin = np.unique(g[q_], return_index=True)
            for group, lo, hi in zip(groups, begin, [*begin[1:], len(q_)]):
                mine, theirs = q_[lo:hi], d_[np.searchsorted(g[d_], group) : np.searchsorted(g[d_], group, "right")]
                r, c, s = nearest_rows(x[mine], x[theirs], ids[mine], ids[theirs], k, metric, drop_self)
                out.append((ids[mine[r]], ids[theirs[c]], s))
        a, b, c = (np.concatenate(z) for z in zip(*out))
        return pa.table({"query_id": a, "doc_id": b, "score": c})

    found = block_pairs(d, q, nd, nq).applyInArrow(work, "query_id long, doc_id long, score double")
    return top_k(found, k).select("query_id", "doc_id", "rank", "score")


def rerank(candidates: DataFrame, records: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """Exact score of candidate pairs (query_id, doc_id): k best. A candidate or query without a
    vector is an error."""
    from ..functions.vectors import cosine, dot, negative_l2

    score = {"cosine": cosine, "dot_product": dot, "euclidean": negative_l2}[metric]
    d = records.select(F.col("id").alias("doc_id"), F.col("vector").alias("dv"))
    q = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("qv"))
    joined = candidates.select("query_id", "doc_id").join(d, "doc_id", "left").join(q, "query_id", "left")
    lost = F.raise_error(F.concat(F.lit("no vector for query "), F.col("query_id").cast("string"), F.lit(", record "), F.col("doc_id").cast("string")))
    scored = joined.withColumn("score", F.when(F.col("dv").isNull() | F.col("qv").isNull(), lost.cast("double")).otherwise(score(F.col("qv"), F.col("dv"))))
    return top_k(scored, k).select("query_id", "doc_id", "rank", "score")


def object_max(scores: DataFrame, owner: DataFrame, k: int = 10) -> DataFrame:
    """Best chunk score of each object: scores (query_id, doc_id, score), owner (doc_id, object_id)."""
    best = scores.join(owner, "doc_id").groupBy("query_id", "object_id").agg(F.max("score").alias("score"))
    return top_k(best, k, id_column="object_id").select("query_id", "object_id", "rank", "score")


def object_topk(records: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """(query_id, object_id, rank, score): the k objects whose best chunk scores highest, over
    all chunks. records (id, vector, grp), where grp is the chunk's object; queries (id, vector)."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    kind = records.schema["grp"].dataType
    d, q, nd, nq = _sides(records, queries.select("id", "vector", F.lit(None).cast(kind).alias("grp")), "grp")

    def work(t: pa.Table) -> pa.Table:
        stored, ids = t.column("stored").to_numpy(), t.column("id").to_numpy()
        x = matrix(t.column("v").combine_chunks()).astype(np.float64, copy=False)
        d_, q_ = np.flatnonzero(stored), np.flatnonzero(~stored)
        owner = t.column("grp").combine_chunks().take(pa.array(d_)).dictionary_encode(null_encoding="encode")
        code = np.asarray(owner.indices)
        by = np.argsort(code, kind="stable")
        d_, begin = d_[by], np.searchsorted(code[by], np.arange(len(owner.dictionary)))
        asked, object_, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        step = max(ROWS * COLUMNS // max(len(d_), 1), 1)
        for at in range(0, len(q_) if len(d_) else 0, step):
            part = q_[at : at + step]
            best = np.maximum.reduceat(_scores(x[part], x[d_], metric), begin, axis=1)
            asked.append(np.repeat(ids[part], len(begin)))
            object_.append(np.tile(np.arange(len(begin)), len(part)))
            score.append(best.ravel())
        return pa.table({"query_id": np.concatenate(asked), "object_id": owner.dictionary.take(pa.array(np.concatenate(object_))), "score": np.concatenate(score)})

    found = block_pairs(d, q, nd, nq).applyInArrow(work, f"query_id long, object_id {kind.simpleString()}, score double")
    best = found.groupBy("query_id", "object_id").agg(F.max("score").alias("score"))
    return top_k(best, k, id_column="object_id").select("query_id", "object_id", "rank", "score")
