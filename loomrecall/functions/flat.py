"""The tokenisers of ``text`` over Arrow batches: all bytes of many texts at once, in numpy.

``bow`` and ``standard`` give the tokens of ``bow_tokens`` and ``standard_terms``, each with the row
of its text; rows ascend, but standard's few runs that need a regular expression come last. All
classes are of ASCII letters, digits and signs, or of everything else, so bytes do for characters."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from . import text as columns


def _table(members: bytes, beyond: bool = False) -> bytes:
    return bytes(int(c in members or (beyond and c >= 128)) for c in range(256))


_UPPER, _LOWER, _DIGITS = columns.UPPER.encode(), columns.LOWER.encode(), b"0123456789"
_ALNUM = _table(_UPPER + _LOWER + _DIGITS)
_FIRST = _table(_UPPER + _LOWER + _DIGITS + b"_./\\-", True)
_RUN = _table(_UPPER + _LOWER + _DIGITS + b"_./\\-:", True)
_SIGN, _END, _DIGIT = _table(b"_-./\\:"), _table(b".:"), _table(_DIGITS)
_UP, _LOW, _LOW_OR_DIGIT = _table(_UPPER), _table(_LOWER), _table(_LOWER + _DIGITS)
_NUMBER, _IDENTIFIER, _PART = (re.compile(p.encode()) for p in (columns.NUMBER.replace(r"\z", r"\Z"), columns.IDENTIFIER, columns.PART))
#: Most runs whose tokens a worker remembers.
REMEMBERED = 1 << 16


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins, with the end; a null text is empty."""
    column = column.fill_null("").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _of(raw: np.ndarray, table: bytes) -> np.ndarray:
    """Whether each byte is in a table."""
    return np.frombuffer(bytearray(raw.tobytes().translate(table)), bool)


def _folded(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw.tobytes().lower(), np.uint8)


def _cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    return at[(at > 0) & (at < len(raw))]


def _runs(inside: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the longest runs; none reaches over a cut."""
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin[cut], last[cut - 1] = inside[cut], inside[cut - 1]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def _rows(begin: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(begin, at)))


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


def bow(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    inside = _of(raw, _ALNUM)
    begin, end = _runs(inside, _cuts(raw, at))
    long = end - begin >= 2
    inside[begin[~long]] = False
    begin, end = begin[long], end[long]
    return _rows(begin, at), _strings(_folded(raw[inside]), end - begin)


def _pieces(run: bytes) -> tuple[bytes, ...]:
    """Tokens of a run; as ``standard_tokens`` says."""
    path = b"/" in run or b"\\" in run
    number = not path and _NUMBER.search(run)
    body = run if number else run.rstrip(b".:")
    out = [body]
    if body and not path and not number and _IDENTIFIER.search(run) and not re.match(rb"-[^0-9]", body):
        parts = [p for p in _PART.split(body) if p]
        if parts != [body]:
            out += parts
    return tuple(t.lower() for t in out if t)


def standard(raw: np.ndarray, at: np.ndarray, seen: dict[bytes, tuple[bytes, ...]]) -> tuple[np.ndarray, pa.Array]:
    """seen: tokens of runs met before. Plain words, also before full stops, need no look at all."""
    cut = _cuts(raw, at)
    begin, end = _runs(_of(raw, _RUN), cut)

    colon = np.flatnonzero(raw[begin] == ord(":"))
    if len(colon):  # a run doesn't begin with one
        first = np.append(np.flatnonzero(_of(raw, _FIRST)), len(raw))
        begin[colon] = first[np.searchsorted(first, begin[colon])]
        some = begin < end
        begin, end = begin[some], end[some]
    row = _rows(begin, at)

    body, ended = end.copy(), np.flatnonzero(_of(raw[end - 1], _END))
    if len(ended):
        other = np.append(-1, np.flatnonzero(~_of(raw, _END)))
        body[ended] = np.maximum(other[np.searchsorted(other, end[ended]) - 1] + 1, begin[ended])
    odd = np.zeros(len(begin), bool)
    some = ended[body[ended] > begin[ended]]
    odd[some] = _of(raw[body[some] - 1], _DIGIT)

    mark, up = _of(raw, _SIGN), _of(raw, _UP)
    camel = _of(raw, _LOW_OR_DIGIT)[:-1] & up[1:]
    camel[:-1] |= up[:-2] & up[1:-1] & _of(raw, _LOW)[2:]
    mark[:-1] |= camel
    marks = np.flatnonzero(mark)
    if len(begin) and len(marks):
        of = np.searchsorted(begin, marks, "right") - 1
        # what a pair or triple of letters begins in one text and ends in the next is looked at once more below
        odd[of[(of >= 0) & (marks < body[of])]] = True

    runs, low = raw.tobytes(), np.flatnonzero(odd)
    out: list[bytes] = []
    count = np.zeros(len(low), np.int64)
    for i, (a, b) in enumerate(zip(begin[low].tolist(), end[low].tolist())):
        run = runs[a:b]
        tokens = seen.get(run)
        if tokens is None:
            if len(seen) >= REMEMBERED:
                seen.clear()
            tokens = seen[run] = _pieces(run)
        count[i] = len(tokens)
        out += tokens

    plain = ~odd & (body > begin)
    b, e = begin[plain], body[plain]
    step = np.zeros(len(raw) + 1, np.int8)
    step[b] += 1
    step[e] -= 1
    words = _folded(raw[np.cumsum(step[:-1], dtype=np.int8).view(bool)])
    data = np.concatenate([words, np.frombuffer(b"".join(out), np.uint8)])
    sizes = np.concatenate([e - b, np.fromiter(map(len, out), np.int64, len(out))])
    return np.concatenate([row[plain], np.repeat(row[low], count)]), _strings(data, sizes)


def tokeniser(terms):
    """The one that stands for a tokeniser of columns, as f(bytes, begins); None if there is none."""
    if terms is columns.bow_tokens:
        return bow
    if terms is columns.standard_terms:
        seen: dict[bytes, tuple[bytes, ...]] = {}
        return lambda raw, at: standard(raw, at, seen)
    return None
