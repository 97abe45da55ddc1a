"""Feature-hashed text embeddings, in Arrow batches."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


MODEL = "external-hash-embedding-32d-v1"


def features(text: str) -> Counter:
    """Tokens, their trigrams (four letters and more) and neighbouring pairs."""
    tokens = re.findall(r"[a-z0-9]+", text.lower())
    found = Counter("tok:" + t for t in tokens)
    found.update("tri:" + t[i : i + 3] for t in tokens if len(t) >= 4 for i in range(len(t) - 2))
    found.update(f"bigram:{a}_{b}" for a, b in zip(tokens, tokens[1:]))
    return found


def embed(text: str | None, dim: int = 32, model: str = MODEL) -> np.ndarray:
    """Unit vector of signed buckets weighted 1 + ln(count); zero for no features."""
    v = np.zeros(dim)
    for f, n in features(text or "").items():
        h = hashlib.sha256(f"{model}|{f}".encode()).digest()
        v[int.from_bytes(h[:4], "little") % dim] += (-1 if h[4] & 1 else 1) * (1 + math.log(n))
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def hashed_embedding(text: Column, dim: int = 32, model: str = MODEL) -> Column:
    return embedding(text, lambda texts: [embed(t, dim, model) for t in texts])


def embedding(text: Column, model: Callable[[list[str | None]], list]) -> Column:
    """Embedding of each text by any model that takes a batch of texts; a wrong number of
    vectors is an error."""

    @F.pandas_udf("array<double>")
    def run(t: pd.Series) -> pd.Series:
        out = list(model(t.tolist()))
        if len(out) != len(t):
            raise ValueError(f"the model gave {len(out)} vectors for {len(t)} texts")
        return pd.Series([np.asarray(v, np.float64) for v in out], index=t.index, dtype=object)

    return run(text)


def fnv1a(data: bytes, basis: int = 0xCBF29CE484222325) -> int:
    """64-bit FNV-1a hash."""
    for b in data:
        basis = ((basis ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return basis
