"""Byte-level BPE by speculate and verify.

Greedy longest match proposes the tokens of a piece. A proposal is the BPE result if
and only if every adjacent pair of its tokens is compatible, that is, BPE of the two
tokens' joined bytes gives the two back; the check walks the merge trees of all pairs
of a batch at once in numpy. Only pieces with an incompatible pair are merged exactly.

Texts split at single spaces, where a piece always starts, so a bounded cache of
space-led chunks serves most of a text; a text with two white-space characters in a
row is split by the tokenizer's own pattern as a whole. The vocabulary is a parameter
(a rank file: base64 token, rank); nothing is trained.

Defined results: null encodes to null, the empty text to no tokens; decoding null gives
null; ids outside the vocabulary raise; repeated rows give equal rows.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .textkit import _BASE, _INV, _powers, mix64

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 1_000_000
_NONE = np.int64(1) << np.int64(40)


class Bpe:
    """Encoder and decoder over one rank file; one per Python worker."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.gap = regex.compile(r"\s\s")
        size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * size
        for t, r in self.ranks.items():
            self.bytes_of[r] = t
        self.longest = max(map(len, self.ranks))
        self._split()
        self.cache: dict[str, bytes] = {}

    def _split(self) -> None:
        """Left and right part of every token's last merge; a byte is its own parts.
        Tokens that merging can't reach are left out of the proposals."""
        size = len(self.bytes_of)
        self.left, self.right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
        self.proposable = dict(self.ranks)
        keys, made = [], []
        for token, rank in self.ranks.items():
            if len(token) == 1:
                continue
            parts = self.merge(token, below=rank)
            if len(parts) == 2:
                self.left[rank], self.right[rank] = parts
                keys.append(parts[0] << 20 | parts[1])
                made.append(rank)
            else:
                del self.proposable[token]
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        ends = np.cumsum([len(t) for t in self.proposable])
        size = np.array([len(t) for t in self.proposable])
        data = np.frombuffer(b"".join(self.proposable), np.uint8)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data), "p"))])
        start = ends - size
        h = mix64((run[ends] - run[start]) * _powers(_INV, len(data) + 1, "i")[start] + size.astype(np.uint64))
        by = np.argsort(h)
        self.hash_keys, self.hash_made = h[by], np.array(list(self.proposable.values()), np.int64)[by]
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys, self.pair_made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]

    def merge(self, piece: bytes, below: int | None = None) -> list[int]:
        """Exact BPE: merge the lowest-ranked adjacent pair, leftmost first, until none is left."""
        ranks, n = self.ranks, len(piece)
        if below is None and piece in ranks and len(piece) == 1:
            return [ranks[piece]]
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 once merged away
        prev = list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n:
                r = ranks.get(piece[a : end[b]])
                if r is not None and (below is None or r < below):
                    heapq.heappush(heap, (r, a, b, end[b]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if end[a] != b or end[b] != c:
                continue
            end[a], end[b] = c, 0
            if c < n:
                prev[c] = a
            offer(a)
            if prev[a] >= 0:
                offer(prev[a])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def propose(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all pieces at once: token and piece number, in order.

        A prefix hash of the bytes gives the hash of any stretch; all pieces advance
        together, from their longest possible match downwards."""
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data), "p"))])
        shift = _powers(_INV, len(data) + 1, "i")
        at, live = start.copy(), np.arange(len(start))
        tokens, owners, steps = [], [], []
        step = 0
        while len(live):
            a = at[live]
            size = np.minimum(end[live] - a, self.longest)
            got = np.full(len(live), -1, np.int64)
            todo = np.arange(len(live))
            while len(todo):
                x, n = a[todo], size[todo]
                h = mix64((run[x + n] - run[x]) * shift[x] + n.astype(np.uint64))
                k = np.minimum(np.searchsorted(self.hash_keys, h), len(self.hash_keys) - 1)
                hit = self.hash_keys[k] == h
                got[todo[hit]] = self.hash_made[k[hit]]
                todo = todo[~hit]
                size[todo] -= 1  # single bytes are always tokens
            tokens.append(got)
            owners.append(live)
            steps.append(np.full(len(live), step))
            at[live] += size
            live = live[at[live] < end[live]]
            step += 1
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        t, o = np.concatenate(tokens), np.concatenate(owners)
        order = np.lexsort((np.concatenate(steps), o))
        return t[order], o[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs (a[i], b[i]) stay apart under BPE of their joined bytes.

        Both trees are unwound from the split point outwards, always the side merged
        later; a pair of facing parts that would merge before either side was complete
        makes the pair incompatible."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), _NONE)
        x, y = a.copy(), b.copy()
        while len(live):
            key = x << np.int64(20) | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merged = np.where(self.pair_keys[at] == key, self.pair_made[at], _NONE)
            bad = merged < limit
            out[live[bad]] = False
            xl, yl = self.right[x] != x, self.left[y] != y
            turn_x = np.where(xl & yl, x > y, xl)
            done = ~xl & ~yl
            # of equal ranks the left occurrence merges first, so b's merge comes after a's
            limit = np.where(turn_x, x, y + 1)
            x, y = np.where(turn_x, self.right[x], x), np.where(turn_x, y, self.left[y])
            go = ~bad & ~done
            live, limit, x, y = live[go], limit[go], x[go], y[go]
        return out

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x << np.int64(20) | y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], _NONE)

    def merge_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Exact BPE of many pieces in lockstep: each round merges the lowest-ranked pair,
        leftmost first, of every piece that has one."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        for low, high in ((2, 8), (9, 16), (17, 32), (33, 64)):
            of = np.flatnonzero((sizes >= low) & (sizes <= high))
            if not len(of):
                continue
            m = int(sizes[of].max())
            t = np.full((len(of), m + 1), -1, np.int64)
            for i, k in enumerate(of):
                t[i, : sizes[k]] = self.byte_id[np.frombuffer(pieces[k], np.uint8)]
            rank = np.where(t[:, 1:] >= 0, self._pair_rank(np.maximum(t[:, :-1], 0), np.maximum(t[:, 1:], 0)), _NONE)
            cols = np.arange(m + 1)
            live = np.arange(len(of))
            while len(live):
                r = rank[live]
                j = r.argmin(axis=1)
                best = r[np.arange(len(live)), j]
                go = best < _NONE
                live, j, best = live[go], j[go], best[go]
                if not len(live):
                    break
                take = np.minimum(cols + (cols > j[:, None]), m)
                x = np.take_along_axis(t[live], take, axis=1)
                x[:, m] = -1
                rows = np.arange(len(live))
                x[rows, j] = best
                q = np.take_along_axis(rank[live], np.minimum(cols[:m] + (cols[:m] >= j[:, None]), m - 1), axis=1)
                q[:, m - 1] = _NONE
                right = x[rows, j + 1]
                q[rows, np.minimum(j, m - 1)] = np.where(right >= 0, self._pair_rank(best, np.maximum(right, 0)), _NONE)
                inner = j > 0
                q[rows[inner], j[inner] - 1] = self._pair_rank(x[rows[inner], j[inner] - 1], best[inner])
                t[live], rank[live] = x, q
            for i, k in enumerate(of):
                out[k] = t[i][t[i] >= 0]
        return [np.array(self.merge(pieces[i]), np.int64) if o is None else o for i, o in enumerate(out)]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Tokens of all pieces in one array, its n+1 bounds, and how many pieces were merged exactly."""
        ends = np.cumsum([len(p) for p in pieces])
        flat, owner = self.propose(np.frombuffer(b"".join(pieces), np.uint8), ends - [len(p) for p in pieces], ends)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] << np.int64(20) | flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs >> np.int64(20), pairs & np.int64((1 << 20) - 1))
        failed = np.unique(owner[inner[~good[back]]])
        if len(failed):
            exact = self.merge_many([pieces[i] for i in failed])
            keep = ~np.isin(owner, failed)
            flat = np.concatenate([flat[keep], *exact])
            owner = np.concatenate([owner[keep], np.repeat(failed, [len(e) for e in exact])])
            order = np.argsort(owner, kind="stable")
            flat, owner = flat[order], owner[order]
        return flat, np.searchsorted(owner, np.arange(len(pieces) + 1)), len(failed)

    def _learn(self, chunks: set[str]) -> None:
        """Put the packed tokens of the chunks into the cache."""
        todo = list(chunks)
        split = [self.pattern.findall(c) for c in todo]
        pieces = list({p for s in split for p in s})
        flat, bound, _ = self.encode_pieces([p.encode() for p in pieces])
        packed = flat.astype(np.int32).tobytes()
        edge = (bound * 4).tolist()
        of = {p: packed[edge[i] : edge[i + 1]] for i, p in enumerate(pieces)}
        for c, s in zip(todo, split):
            self.cache[c] = of[s[0]] if len(s) == 1 else b"".join(map(of.__getitem__, s))

    def encode_batch(self, texts: list[str | None]) -> list[bytes | None]:
        """Packed int32 token ids of each text."""
        chunked: list[list[str] | None] = []
        for t in texts:
            if not t:
                chunked.append([] if t is not None else None)
            elif self.gap.search(t):
                chunked.append(self.pattern.findall(t))
            else:
                parts = t.split(" ")
                chunked.append(([parts[0]] if parts[0] else []) + [" " + p for p in parts[1:]])
        have = self.cache
        unknown = {c for cs in chunked if cs for c in cs} - have.keys()
        if unknown:
            if len(have) + len(unknown) > CACHE:
                have.clear()
                unknown = {c for cs in chunked if cs for c in cs}
            self._learn(unknown)
        return [None if cs is None else b"".join(map(have.__getitem__, cs)) for cs in chunked]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Bpe:
    return Bpe(path)


def packed_lists(packed: list[bytes | None]) -> pa.ListArray:
    sizes = np.array([len(p) // 4 if p is not None else 0 for p in packed], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(p for p in packed if p), np.int32))
    mask = pa.array([p is None for p in packed], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, verify: bool = True) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip): round_trip tells whether decoding gives
    the text back; null for a null text. Map-only: nothing is shuffled."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32()))]
    schema = pa.schema(fields + ([("round_trip", pa.bool_())] if verify else []))

    def work(batches):
        bpe = encoder(vocabulary)
        for whole in batches:
            for b in slices(whole, "t"):
                texts = b.column(1).to_pylist()
                packed = bpe.encode_batch(texts)
                n = pa.array([None if p is None else len(p) // 4 for p in packed], pa.int64())
                columns = [b.column(0), n, packed_lists(packed).cast(pa.list_(pa.int32()))]
                if verify:
                    same = [None if p is None else bpe.decode(np.frombuffer(p, np.int32)) == t for p, t in zip(packed, texts)]
                    columns.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    src = docs.select(docs["doc_id"].cast("long").alias("i"), docs["text"].alias("t"))
    kind = "doc_id long, n_tokens long, token_ids array<int>" + (", round_trip boolean" if verify else "")
    return src.mapInArrow(work, kind)


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of the token lists in columns doc_id and token_ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def work(batches):
        bpe = encoder(vocabulary)
        for b in batches:
            texts = [None if t is None else bpe.decode(np.array(t, np.int64)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema=schema)

    src = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("token_ids"))
    return src.mapInArrow(work, "doc_id long, text string")
