"""Documents scored where they lie, against all queries at once.

A document meets nearly every query in some common word, so the pairs of both are as many
as documents times queries, and none is shuffled here: the queries' terms, if they are few
enough to be sent to every worker, are looked up in each document's tokens, and of every
query a partition returns its k best. Callers join term by term instead where ``plan`` is None."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flat

#: Most rows (query, term) that are sent to every worker; cells and postings scored at once.
ROWS, CELLS = 200_000, 1 << 21
#: Bytes of text tokenised at once.
PIECE = 4 << 20


@dataclass
class Texts:
    """Documents (id, text) with their tokeniser. Texts are sent to the workers and tokenised there,
    which costs a small part of making lists of tokens in the JVM and sending those."""

    df: DataFrame
    terms: Callable[[Column], Column]

    def tokens(self) -> DataFrame:
        return self.df.select("id", self.terms(F.col("text")).alias("terms"))


def token_lists(tokens: DataFrame | Texts) -> DataFrame:
    """(id, terms)."""
    return tokens.tokens() if isinstance(tokens, Texts) else tokens


def document_ids(tokens: DataFrame | Texts) -> DataFrame:
    return (tokens.df if isinstance(tokens, Texts) else tokens).select("id")


@dataclass
class Plan:
    """Queries' terms in the order of terms: row i has term ``code[i]`` and query ``query[i]``."""

    terms: pa.Array
    ids: pa.Array
    code: np.ndarray
    query: np.ndarray
    columns: dict[str, np.ndarray]

    def starts(self) -> np.ndarray:
        return np.searchsorted(self.code, np.arange(len(self.terms) + 1))


def plan(tokens: DataFrame | Texts, asked: DataFrame) -> Plan | None:
    """Of asked (query_id, term, ...), or None where it is too large, or where documents can't be
    scored one by one: ids that repeat, or that are no whole numbers."""
    documents = document_ids(tokens)
    if documents.schema["id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return None
    t = asked.limit(ROWS + 1).toArrow()
    if t.num_rows > ROWS or not documents.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        return None
    # chunks of dictionaries differ, so columns are made one first
    term, query = (t.column(c).combine_chunks().dictionary_encode() for c in ("term", "query_id"))
    code = np.asarray(term.indices)
    order = np.argsort(code, kind="stable")
    rest = {c: t.column(c).to_numpy()[order] for c in t.column_names if c not in ("term", "query_id")}
    return Plan(term.dictionary, query.dictionary, code[order], np.asarray(query.indices)[order], rest)


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row of every element, and the elements. A null list has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(pc.list_value_length(column).fill_null(0))
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _tokens(batch: pa.RecordBatch, cut):
    """For some rows after others: (first, last, row of each token counted from the first, tokens)."""
    if cut is None:
        yield 0, batch.num_rows, *_lists(batch.column("terms"))
        return
    raw, at = flat.texts(batch.column("text"))
    lo = 0
    while lo < batch.num_rows:
        hi = max(int(np.searchsorted(at, at[lo] + PIECE, "right")) - 1, lo + 1)
        yield lo, hi, *cut(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def found(tokens: DataFrame | Texts, p: Plan, norms: bool = False) -> DataFrame:
    """(id, len, codes, tfs[, sq]): of each document the asked terms; sq sums the squares of all its
    terms' counts."""
    cut = flat.tokeniser(tokens.terms) if isinstance(tokens, Texts) else None
    source = token_lists(tokens).select("id", "terms") if cut is None else tokens.df.select("id", "text")
    terms = p.terms.cast(pa.large_string())
    size = max(len(terms), 1)

    def work(batches):
        for batch in batches:
            for lo, hi, row, words in _tokens(batch, cut):
                n = hi - lo
                out = {"id": batch.column("id")[lo:hi].cast(pa.int64()), "len": pa.array(np.bincount(row, minlength=n).astype(np.int64))}
                if norms:
                    every = words.dictionary_encode()
                    code, words = np.asarray(every.indices), every.dictionary
                    key, tf = np.unique(row * max(len(words), 1) + code, return_counts=True)
                    out["sq"] = pa.array(np.bincount(key // max(len(words), 1), weights=tf.astype(float) ** 2, minlength=n))
                asked = np.asarray(pc.index_in(words.cast(pa.large_string()), value_set=terms).fill_null(-1)).astype(np.int64)
                asked = asked[code] if norms else asked
                have = asked >= 0
                key, tf = np.unique(row[have] * size + asked[have], return_counts=True)
                at, asked = np.divmod(key, size)
                begin = pa.array(np.searchsorted(at, np.arange(n + 1)), pa.int32())
                out |= {"codes": pa.ListArray.from_arrays(begin, pa.array(asked.astype(np.int32))), "tfs": pa.ListArray.from_arrays(begin, pa.array(tf.astype(np.int32)))}
                yield pa.RecordBatch.from_pydict({c: out[c] for c in ("id", "len", "codes", "tfs", *(["sq"] if norms else []))})

    return source.mapInArrow(work, "id long, len long, codes array<int>, tfs array<int>" + (", sq double" if norms else ""))


def frequencies(docs: DataFrame, p: Plan) -> tuple[np.ndarray, int, int]:
    """Documents of each asked term, documents, and tokens; one row a term and partition is shuffled."""
    size = len(p.terms)

    def work(batches):
        have = np.zeros(size + 2, np.int64)
        for batch in batches:
            have[:size] += np.bincount(np.asarray(_lists(batch.column("codes"))[1]), minlength=size)
            have[size:] += batch.num_rows, pc.sum(batch.column("len")).as_py() or 0
        yield pa.RecordBatch.from_pydict({"code": np.flatnonzero(have), "n": have[have > 0]})

    df = np.zeros(size + 2, np.int64)
    for code, n in docs.select("codes", "len").mapInArrow(work, "code long, n long").groupBy("code").agg(F.sum("n")).collect():
        df[code] = n
    return df[:size], int(df[size]), int(df[size + 1])


def _met(batch: pa.RecordBatch, p: Plan, start: np.ndarray):
    """For some documents after others: (first, last, document, row of the plan, posting's tf) of what meets."""
    row, code = _lists(batch.column("codes"))
    code, tf = np.asarray(code), np.asarray(_lists(batch.column("tfs"))[1])
    times = np.diff(start)[code]
    # so many documents that neither their cells nor what meets in them is large
    work = np.cumsum(np.bincount(row, weights=times, minlength=batch.num_rows) + len(p.ids)).astype(np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(int(np.searchsorted(work, (work[lo - 1] if lo else 0) + CELLS, "right")), lo + 1)
        a, b = np.searchsorted(row, (lo, hi))
        n = times[a:b]
        posting = np.repeat(np.arange(a, b), n)
        at = np.arange(len(posting)) - np.repeat(np.cumsum(n) - n, n) + start[code[posting]]
        yield lo, hi, row[posting], at, tf[posting]
        lo = hi


def best(docs: DataFrame, p: Plan, k: int, kind: str, part) -> DataFrame:
    """(query_id, doc_id, score): of each partition, every query's k best above 0, ties by id.
    docs as of ``found``; part(row of the plan, tf, len): what a posting adds to the score.
    With a column sq, scores are divided by its root."""
    start = p.starts()
    ids, query, n_q = p.ids, p.query, len(p.ids)

    def work(batches):
        from .vectors import Best

        kept = Best(n_q, k, ordered=False)
        for batch in batches:
            doc, length = batch.column("id").to_numpy(), batch.column("len").to_numpy()
            for lo, hi, row, at, tf in _met(batch, p, start):
                s = np.bincount((row - lo) * n_q + query[at], weights=part(at, tf, length[row]), minlength=(hi - lo) * n_q).reshape(hi - lo, n_q)
                if "sq" in batch.schema.names:
                    norm = np.sqrt(batch.column("sq").to_numpy()[lo:hi])[:, None]
                    s = np.divide(s, norm, out=np.zeros_like(s), where=norm > 0)
                d, q = np.nonzero((s > 0) & (s >= kept.edge[None, :] - 2e-9))
                kept.add(q, doc[lo + d], np.round(s[d, q], 9), s[d, q])
        q, d, s = kept.result()
        yield pa.RecordBatch.from_pydict({"query_id": ids.take(pa.array(q)), "doc_id": d, "score": s})

    return docs.mapInArrow(work, f"query_id {kind}, doc_id long, score double")


def every(docs: DataFrame, p: Plan, kind: str, clauses: tuple[str, ...], test) -> DataFrame:
    """(query_id, doc_id, n) of all pairs that pass: test(counts of each clause) gives n, or 0."""
    start = p.starts()
    ids, query, n_q, clause = p.ids, p.query, len(p.ids), p.columns["clause"]

    def work(batches):
        for batch in batches:
            doc = batch.column("id").to_numpy()
            for lo, hi, row, at, _ in _met(batch, p, start):
                cell, of = (row - lo) * n_q + query[at], clause[at]
                n = test(*(np.bincount(cell[of == c], minlength=(hi - lo) * n_q).reshape(hi - lo, n_q) for c in clauses))
                d, q = np.nonzero(n)
                yield pa.RecordBatch.from_pydict({"query_id": ids.take(pa.array(q)), "doc_id": doc[lo + d], "n": n[d, q].astype(np.int64)})

    return docs.mapInArrow(work, f"query_id {kind}, doc_id long, n long")


def spans(tokens: DataFrame) -> DataFrame:
    """(id, term, tf, first, last) of every row's terms, without a shuffle."""

    def work(batches):
        for batch in batches:
            row, flat = _lists(batch.column("terms"))
            n = batch.num_rows
            pos = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
            every = flat.dictionary_encode()
            code, size = np.asarray(every.indices), max(len(every.dictionary), 1)
            order = np.argsort(row * size + code, kind="stable")
            key = (row * size + code)[order]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool))
            end = np.append(begin[1:], len(key))[: len(begin)]
            first, last = order[begin], order[end - 1]
            out = {"id": batch.column("id").take(pa.array(row[first])), "term": every.dictionary.take(pa.array(code[first])), "tf": end - begin}
            out |= {"first": pos[first].astype(np.int32), "last": pos[last].astype(np.int32)}
            yield pa.RecordBatch.from_pydict(out)

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "terms").mapInArrow(work, f"id {kind}, term string, tf long, first int, last int")
