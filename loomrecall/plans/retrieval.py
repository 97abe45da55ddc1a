"""Retrieval pipelines composed from operators; every hook is a function on DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import passthrough_terms
from ..operators import binary, lexical
from ..operators.tables import bounded_broadcast, materialize

Hook = Callable[[DataFrame], DataFrame]


def metadata_filter(metadata: Column, filters: Column) -> Column:
    """All filters (array of key, value) hold; a missing key fails, no filters pass."""
    return F.forall(filters, lambda f: F.coalesce(F.element_at(metadata, f["key"]) == f["value"], F.lit(False)))


def retrieve(tokens: DataFrame | lexical.scan.Texts, texts: DataFrame, queries: DataFrame, k: int = 10, analyzer: Callable[[Column], Column] = passthrough_terms, reranker: Hook | None = None) -> DataFrame:
    """Analyse (query_id, text), rank by BM25, cut to k, rerank, then join the texts (doc_id, ...).

    A query without words is searched as one term; blank ones find nothing."""
    terms = analyzer(F.col("text"))
    q = queries.where("length(trim(coalesce(text, ''))) > 0").select("query_id", F.when(F.size(terms) > 0, terms).otherwise(F.array("text")).alias("terms"))
    hits = lexical.bm25(tokens, q, k) if k > 0 else lexical.bm25(tokens, q, 1).limit(0)
    hits = reranker(hits) if reranker else hits
    # k rows a query: as a rule texts stay where they are
    hits = materialize(hits, "hits")
    return bounded_broadcast(hits, hits.count(), 64).join(texts, "doc_id")


def two_stage(records: DataFrame, queries: DataFrame, k: int = 10, candidates: int = 64, drop_self: bool = False) -> DataFrame:
    """Hamming candidates, then exact cosine; tables have (id, vector, words)."""
    found = binary.hamming_scored(records, queries, candidates, drop_self=drop_self)
    return lexical.top_k(found, k).select("query_id", "doc_id", "rank", "score")


def coverage(exact: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, coverage, top1): share of the exact hits among the candidates, and whether the first is."""
    c = candidates.select("query_id", "doc_id").distinct().withColumn("in", F.lit(1.0))
    joined = exact.join(c, ["query_id", "doc_id"], "left").withColumn("in", F.coalesce("in", F.lit(0.0)))
    return joined.groupBy("query_id").agg(F.avg("in").alias("coverage"), F.max(F.when(F.col("rank") == 1, F.col("in"))).alias("top1"))


def decay(score: Column, age: Column, scale: float, kind: str = "exponential", uses: Column | None = None, boost: float = 0.0) -> Column:
    """Score weighted by age; optionally raised by use."""
    if kind == "exponential":
        aged = score * F.exp(-age / scale)
    elif kind == "linear":
        aged = score * F.greatest(F.lit(0.0), 1 - age / scale)
    elif kind == "logistic":
        aged = score / (1 + F.exp((age - scale) / (scale / 4)))
    else:
        raise ValueError(f"unknown decay {kind}")
    return aged if uses is None else aged + boost * F.log1p(uses)


def sliding_chunks(docs: DataFrame, size: int = 1024, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk, n_words, text): windows of ``size`` words that share ``overlap``."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    step = size - overlap
    w = docs.select("doc_id", words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - overlap) / step) - 1).cast("int")
    each = w.select("doc_id", "w", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).alias("chunk", "at"))
    part = F.slice("w", F.col("at") + 1, F.lit(size))
    return each.select("doc_id", "chunk", F.size(part).alias("n_words"), F.array_join(part, " ").alias("text"))


def any_of(*tests: Column) -> Column:
    """One of the tests holds; null counts as false."""
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def in_range(value: Column, low=None, high=None) -> Column:
    """low <= value < high, either end open; a null value is outside."""
    ok = value.isNotNull()
    if low is not None:
        ok = ok & (value >= F.lit(low))
    return ok if high is None else ok & (value < F.lit(high))


def has_tags(tags: Column, wanted: list[str], every: bool = True) -> Column:
    """All, or any, of the wanted tags are among a row's."""
    have = F.array(*map(F.lit, wanted))
    hit = F.size(F.array_except(have, tags)) == 0 if every else F.arrays_overlap(tags, have)
    return F.coalesce(hit, F.lit(False))


def cooled_down(hits: DataFrame, uses: DataFrame, now: Column, seconds: float) -> DataFrame:
    """hits (asker, item_id, ...) without the items that the asker was given within so many
    seconds before now, and without the asker's own (self-echo): uses (asker, item_id, at,
    own). Uses are reduced to one row an item first."""
    last = uses.groupBy("asker", "item_id").agg(F.max("at").alias("__last"), F.max("own").alias("__own"))
    joined = hits.join(last, ["asker", "item_id"], "left")
    fresh = F.col("__last").isNull() | (now.cast("double") - F.col("__last").cast("double") >= seconds)
    return joined.where(fresh & ~F.coalesce("__own", F.lit(False))).select(*hits.columns)


def graph_expand(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(seed, node, hops): nodes within ``depth`` edges of each seed, with the fewest hops.
    seeds: (seed); edges: (src, dst)."""
    from ..operators.tables import materialize

    edge = edges.select("src", "dst").distinct()
    found = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops")).distinct()
    front = found
    for hop in range(1, depth + 1):
        step = front.join(edge, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), F.lit(hop).alias("hops")).distinct()
        front = materialize(step.join(found, ["seed", "node"], "left_anti"), "front")
        found = found.unionByName(front)
    return found
