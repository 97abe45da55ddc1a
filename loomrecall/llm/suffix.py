"""Suffix-array deduplication of repeated passages.

A passage is a window of ``MIN_WORDS`` words. A window that also occurs in a document
with a smaller doc_id is a repeat; the words that repeats cover are removed, so the
first document keeps the passage. The search is exact and needs no cap:

1. Every window has one anchor: among its stretches of ``LEAD`` words the one with the
   smallest hash. Equal windows have equal anchors at equal places, so only windows
   that share an anchor need to be compared. Anchors whose leading words occur in one
   document only are dropped; what is shuffled for this is a few numbers per anchor.
2. The documents with anchors left give for each of them the suffix segment that holds
   all windows of that anchor. Spark range-partitions the segments by their leading
   words (hash of the first two, then of all ``LEAD``) at sampled splitters.
3. A bucket builds its suffix order over its distinct segments by multikey quicksort:
   windows are split by anchor and offset, then by one pair of words after another,
   groups of one leaving at once. What is left in groups are equal windows. Equal
   leading words always meet in one bucket, so across a bucket boundary neighbours
   differ within their leading words, fewer than a passage, and compare as unequal.
4. Repeated windows become word spans, merged per document.

Words are runs of non-white-space; they are compared by 64-bit hashes of their bytes
(32 bits each in the segments, together with the anchor's 64 bits).

Defined results: null and short texts have no passages; a passage repeated only within
one document stays; very long texts are searched whole; rows that repeat a doc_id count as one document, in each of whose
different texts passages are found, and a row loses those of its own text; rows without a
doc_id stay as they are; a document left without words is dropped; empty tables give
empty results; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, record_batch, slices
from .textkit import Words, ngram_hashes, string_buffer, words_of

MIN_WORDS = 50
LEAD = 8
_LOW = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _places_of_min(x: np.ndarray, width: int, block: int = 1 << 24) -> np.ndarray:
    """Place of the least of every ``width`` neighbours by their upper 40 bits, the first of
    equal ones. Places are packed below these bits, so long arrays are taken block by block."""
    out = []
    for at in range(0, len(x) - width + 1, block - width + 1):
        part = x[at : at + block]
        ranked = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        out.append((_sliding_min(ranked, width) & _LOW).astype(np.int64) + at)
    return np.concatenate(out)


def anchored(w: Words, min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """Runs of windows that share an anchor: row, first window (word number in the text),
    number of windows, anchor's place, its hash, hashes of its first two words. Windows
    that occurred before in the same text are left out of the runs; ``again`` has their
    place in the text, run and place in the run."""
    h = w.hashes(fold=False)
    n = len(h) - min_words + 1
    none = {k: np.zeros(0, np.int64) for k in ("row", "first", "n", "anchor", "key", "lead")}
    none |= {"hash": h, "again": np.zeros((3, 0), np.int64)}
    if n <= 0:
        return none
    fits = w.row[:n] == w.row[min_words - 1 :]
    at = np.flatnonzero(fits)
    if not len(at):
        return none
    # only the first of equal windows of a text
    whole = ngram_hashes(h, min_words)[at] ^ (w.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, back = np.unique(whole, return_index=True, return_inverse=True)
    later = np.zeros((2, 0), np.int64)  # places of a repeat in the text and of the window it repeats
    if len(first) < len(at):
        source = at[first[back]]
        later = np.stack([at, source])[:, source != at]
        at = np.sort(at[first])
    lead = ngram_hashes(h, LEAD)
    anchor = _places_of_min(lead, min_words - LEAD + 1)[at]
    begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    size = np.diff(np.concatenate([begin, [len(at)]]))
    a, row = anchor[begin], w.row[at[begin]]
    kept = np.searchsorted(at, later[1])
    run = np.searchsorted(begin, kept, side="right") - 1
    again = np.stack([later[0] - w.first[w.row[later[0]]], run, kept - begin[run]]) if later.size else np.zeros((3, 0), np.int64)
    two = (h >> np.uint64(32)).astype(np.uint64)
    return {
        "row": row,
        "first": at[begin] - w.first[row],
        "n": size,
        "anchor": a - w.first[row],
        "key": lead[a].view(np.int64),
        "lead": ((two[a] << np.uint64(31)) | (two[a + 1] >> np.uint64(1))).view(np.int64),
        "hash": h,
        "again": again,
    }


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("i"), docs["text"].alias("t")).where("i is not null and t is not null")


def repeated_anchors(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(i, keys): anchors of document i whose leading words also occur in another document."""
    schema = pa.schema([("i", pa.int64()), ("k", pa.int64())])

    def find(batches):
        for whole in batches:
            for b in slices(whole, "t"):
                x = anchored(words_of(b.column(1)), min_words)
                ids = np.asarray(b.column(0))[x["row"]]
                keep = np.unique(np.stack([ids, x["key"]]), axis=1) if len(ids) else np.zeros((2, 0), np.int64)
                yield record_batch(schema, [keep[0], keep[1]])

    pair = pa.schema([("i", pa.int64()), ("k", pa.int64())])

    def shared(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        ids = np.concatenate([np.asarray(b.column(0)) for b in parts])
        keys = np.concatenate([np.asarray(b.column(1)) for b in parts])
        order = np.lexsort((ids, keys))
        ids, keys = ids[order], keys[order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        last = np.concatenate([begin[1:], [len(keys)]]) - 1
        several = ids[begin] != ids[last]
        keep = np.repeat(several, last - begin + 1)
        yield record_batch(pair, [ids[keep], keys[keep]])

    found = _texts(docs).mapInArrow(find, "i long, k long").repartition("k").mapInArrow(shared, "i long, k long")
    return found.groupBy("i").agg(F.collect_set("k").alias("keys"))


def segments(texts: DataFrame, anchors: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Suffix segments of the repeated anchors, with 32-bit word hashes in ``words``."""
    schema = pa.schema(
        [("lead", pa.int64()), ("k", pa.int64()), ("i", pa.int64()), ("first", pa.int32()), ("off", pa.int32()), ("words", pa.binary()), ("again", pa.binary())]
    )

    def cut(batches):
        for whole in batches:
            for b in slices(whole, "t"):
                w = words_of(b.column(1))
                x = anchored(w, min_words)
                if not len(x["row"]):
                    continue
                wanted, sizes = b.column(2).flatten(), np.asarray(pa.compute.list_value_length(b.column(2)))
                owner = np.repeat(np.arange(b.num_rows), sizes).astype(np.uint64)
                salt = np.uint64(0x9E3779B97F4A7C15)
                have = np.isin(x["key"].view(np.uint64) ^ (x["row"].astype(np.uint64) * salt), np.asarray(wanted).view(np.uint64) ^ (owner * salt))
                row, first, n, anchor = (x[c][have] for c in ("row", "first", "n", "anchor"))
                small = (x["hash"] >> np.uint64(32)).astype("<u4")
                begin = w.first[row] + first
                buffer = small.tobytes()
                words = [buffer[4 * s : 4 * (s + k + min_words - 1)] for s, k in zip(begin.tolist(), n.tolist())]
                again = [b""] * len(have)
                place, run, inside = x["again"]
                order = np.argsort(run, kind="stable")
                pairs = np.stack([inside, place], axis=1)[order].astype("<i4")
                runs, begin_, n_ = np.unique(run[order], return_index=True, return_counts=True)
                for r, s, k in zip(runs.tolist(), begin_.tolist(), n_.tolist()):
                    again[r] = pairs[s : s + k].tobytes()
                again = [a for a, keep in zip(again, have.tolist()) if keep]
                yield record_batch(
                    schema,
                    [x["lead"][have], x["key"][have], np.asarray(b.column(0))[row], first.astype(np.int32), (anchor - first).astype(np.int32), pa.array(words, pa.binary()), pa.array(again, pa.binary())],
                )

    return texts.join(anchors, "i").select("i", "t", "keys").mapInArrow(cut, "lead long, k long, i long, first int, off int, words binary, again binary")


def equal_windows(words: np.ndarray, where: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the windows that begin at ``where`` in ``words``.

    group: known first keys. Gives the windows (numbers into ``where``) that have an equal
    and a label for each set of equal windows."""
    live = np.arange(len(where))
    label = group.astype(np.int64)
    for depth in (-1, *range(0, width, 2)):
        if depth >= 0:
            first = words[where[live] + depth].astype(np.uint64)
            second = words[where[live] + depth + 1].astype(np.uint64) if depth + 1 < width else np.zeros(len(live), np.uint64)
            order = np.lexsort((first << np.uint64(32) | second, label))
            key = (first << np.uint64(32) | second)[order]
        else:
            order = np.argsort(label, kind="stable")
            key = np.zeros(len(live), np.uint64)
        live, label = live[order], label[order]
        if not len(live):
            break
        new = np.concatenate([[True], (label[1:] != label[:-1]) | (key[1:] != key[:-1])])
        number = np.cumsum(new) - 1
        several = np.bincount(number)[number] > 1
        live, label = live[several], number[several]
    return live, label


def repeats_of_bucket(lead, k, ids, first, off, words: list[bytes], again: list[bytes], min_words: int = MIN_WORDS):
    """Spans (document, begin word, end word, first document) of one bucket's segments."""
    found: dict[tuple, int] = {}
    rep = np.fromiter((found.setdefault(x, len(found)) for x in zip(k.tolist(), off.tolist(), words)), np.int64, len(words))
    n_rep = len(found)
    least = np.full(n_rep, np.iinfo(np.int64).max)
    np.minimum.at(least, rep, ids)
    reps = list(found)
    size = np.array([len(r[2]) // 4 for r in reps], np.int64)
    base = np.cumsum(size) - size
    buffer = np.frombuffer(b"".join(r[2] for r in reps), "<u4")
    n = size - min_words + 1
    window_rep = np.repeat(np.arange(n_rep), n)
    inside = np.arange(len(window_rep)) - np.repeat(np.cumsum(n) - n, n)
    where = base[window_rep] + inside
    # first keys: anchor and place of the anchor in the window
    key = np.array([r[0] for r in reps], np.int64)[window_rep]
    place = np.array([r[1] for r in reps], np.int64)[window_rep] - inside
    _, key = np.unique(key, return_inverse=True)
    live, label = equal_windows(buffer, where, key * (min_words + 1) + place, min_words)
    head = least[window_rep].copy()  # smallest document of each window
    if len(live):
        order = np.argsort(label, kind="stable")
        live, label = live[order], label[order]
        begin = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
        head[live] = np.repeat(np.minimum.reduceat(head[live], begin), np.diff(np.concatenate([begin, [len(live)]])))
    # per segment: the runs of windows whose smallest document is another one
    start = np.cumsum(n) - n
    low = np.array([head[s : s + m].min() for s, m in zip(start.tolist(), n.tolist())], np.int64)
    hit = np.flatnonzero(low[rep] < ids)
    spans = []
    for s in hit.tolist():
        r = rep[s]
        h = head[start[r] : start[r] + n[r]]
        mark = np.concatenate([[False], h < ids[s], [False]])
        edge = np.flatnonzero(mark[1:] != mark[:-1])
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
            spans.append((ids[s], first[s] + a, first[s] + z - 1 + min_words, h[a:z].min()))
        if again[s]:  # the document's own repeats of these windows go too
            inside, place = np.frombuffer(again[s], "<i4").reshape(-1, 2).T
            gone = h[inside] < ids[s]
            spans += [(ids[s], p, p + min_words, f) for p, f in zip(place[gone].tolist(), h[inside[gone]].tolist())]
    return spans


def _one_text(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One text (i, t) for each i, and (i, h, at, n): hash, first word and number of words of
    each text that was joined into it. Different texts of one i are joined with a word between
    them that no other i has, so no window across them is a repeat."""
    again = texts.groupBy("i").count().where("count > 1").select("i")
    own = materialize(texts.join(again, "i").groupBy("i").agg(F.array_sort(F.collect_set("t")).alias("ts")), "texts")
    mark = lambda x, n: F.concat(x, F.lit(" \x01"), F.col("i").cast("string"), F.lit(":"), n.cast("string"))
    joined = F.when(F.size("ts") == 1, F.col("ts")[0]).otherwise(F.array_join(F.transform("ts", mark), " "))
    schema = pa.schema([("i", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])

    def places(batches):
        for b in batches:
            for r in range(b.num_rows):
                n = np.diff(words_of(b.column(1)[r].values).first)
                at = np.cumsum(n + 1) - n - 1
                yield record_batch(schema, [np.repeat(np.asarray(b.column(0))[r], len(n)), b.column(2)[r].values, at, n])

    several = own.where("size(ts) > 1").select("i", "ts", F.transform("ts", lambda x: F.xxhash64(x)).alias("hs"))
    parts = several.mapInArrow(places, "i long, h long, at long, n long")
    return texts.join(again, "i", "left_anti").unionByName(own.select("i", joined.alias("t"))), parts


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, begin, end, first_doc_id, text_hash): the word spans [begin, end) of a document
    whose passages also occur in documents with smaller doc_ids, the smallest of them in
    first_doc_id. text_hash (xxhash64) tells which text of a doc_id with several they are in;
    it is null where the doc_id has one text."""
    texts, parts = _texts(docs), None
    if _repeats_ids(docs):
        texts, parts = _one_text(texts)
    schema = pa.schema([("i", pa.int64()), ("b", pa.int32()), ("e", pa.int32()), ("f", pa.int64())])

    def bucket(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        columns = [np.asarray(t.column(c).combine_chunks()) for c in range(5)]
        # one set of equal leading words after another, some thousands together
        order = np.lexsort((columns[1], columns[0]))
        keys = columns[1][order]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        cuts, at = [0], 0
        for e in edge[1:].tolist():
            if e - at >= 20_000:
                cuts.append(e)
                at = e
        if cuts[-1] != len(order):
            cuts.append(len(order))
        words, again = t.column(5), t.column(6)
        for a, z in zip(cuts, cuts[1:]):
            o = order[a:z]
            spans = repeats_of_bucket(*(c[o] for c in columns), words.take(pa.array(o)).to_pylist(), again.take(pa.array(o)).to_pylist(), min_words)
            if spans:
                yield record_batch(schema, [np.array(x, kind) for x, kind in zip(zip(*spans), (np.int64, np.int32, np.int32, np.int64))])

    found = segments(texts, repeated_anchors(texts.select(F.col("i").alias("doc_id"), F.col("t").alias("text")), min_words), min_words)
    spans = found.repartitionByRange("lead", "k").mapInArrow(bucket, "i long, b int, e int, f long")
    merged = pa.schema([("doc_id", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("first_doc_id", pa.int64())])

    def merge(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        i, b, e, f = (np.asarray(t.column(c).combine_chunks()) for c in range(4))
        order = np.lexsort((e, b, i))
        i, b, e, f = i[order], b[order], e[order], f[order]
        # running end within a document; a gap begins a new span
        far = np.maximum.accumulate(e + (np.cumsum(np.concatenate([[0], i[1:] != i[:-1]])) << 32))
        far = (far & 0xFFFFFFFF).astype(np.int64)
        new = np.concatenate([[True], (i[1:] != i[:-1]) | (b[1:] > far[:-1])])
        at = np.flatnonzero(new)
        last = np.concatenate([at[1:], [len(i)]]) - 1
        yield record_batch(merged, [i[at], b[at], far[last].astype(np.int32), np.minimum.reduceat(f, at)])

    found = spans.repartition("i").mapInArrow(merge, "doc_id long, begin int, end int, first_doc_id long")
    if parts is None:
        return found.withColumn("text_hash", F.lit(None).cast("long"))
    placed = found.join(parts, found["doc_id"] == parts["i"], "left").where("at is null or (begin >= at and end <= at + n)")
    here = lambda c: (F.col(c) - F.coalesce("at", F.lit(0))).cast("int").alias(c)
    return placed.select("doc_id", here("begin"), here("end"), "first_doc_id", F.col("h").alias("text_hash"))


def _repeats_ids(docs: DataFrame) -> bool:
    """Whether any doc_id occurs twice; reads the id column only."""
    return bool(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words in the spans; what lies between kept words stays as it is."""
    w = Words(*string_buffer(pa.array([text])))
    data = w.data.tobytes()
    out, at = [], 0
    for b, e in sorted(spans):
        e = min(e, len(w.start))
        if b >= e:
            continue
        out.append(data[at : w.start[b]])
        at = int(w.start[e]) if e < len(w.start) else len(data)
    out.append(data[at:])
    return b"".join(out).decode("utf-8", errors="ignore").strip()


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated passages cut out of ``text`` (and ``n_chars`` set anew in the
    changed rows); all columns kept, documents left without words dropped."""
    spans = (
        repeated_passages(docs, min_words)
        .groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
        .agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("__spans"))
    )
    same = spans["__hash"].isNull() | (spans["__hash"] == F.xxhash64(docs["text"]))
    joined = docs.join(spans, (docs["doc_id"].cast("long") == spans["__id"]) & same, "left").drop(spans["__id"], spans["__hash"])
    names = docs.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None
    out_schema = docs.schema

    def cut(batches):
        for b in batches:
            hit = np.asarray(b.column(len(names)).is_valid())
            columns = [b.column(c) for c in range(len(names))]
            if hit.any():
                text, spans_ = columns[at].to_pylist(), b.column(len(names))
                n = None if chars is None else columns[chars].to_pylist()
                for r in np.flatnonzero(hit).tolist():
                    if text[r] is not None:
                        text[r] = without_spans(text[r], [(s["begin"], s["end"]) for s in spans_[r].as_py()])
                        if n is not None:
                            n[r] = len(text[r])
                columns[at] = pa.array(text, columns[at].type)
                if n is not None:
                    columns[chars] = pa.array(n, columns[chars].type)
                left = [not h or bool(t and t.strip()) for h, t in zip(hit.tolist(), text)]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(left))
            else:
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, out_schema)
