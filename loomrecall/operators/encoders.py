"""Binary encoders: trained and built with numpy on the driver, applied by Arrow UDFs.

An encoder is a float32 projection with thresholds (or a fast Hadamard scheme); training
sees a bounded, deterministic sample. 64-bit mixing wraps in numpy, which Spark's ANSI
arithmetic would refuse."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAINING = 2048
_M = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.uint64).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x = (x * np.uint64(factor)).astype(np.uint64)
    return x ^ (x >> np.uint64(31))


def _seeded(seed: int, salt: int, values: np.ndarray, add: int) -> np.ndarray:
    return mix(np.uint64((seed ^ salt) & _M) ^ (values.astype(np.uint64) + np.uint64(add)))


def _then(state: np.ndarray, values: np.ndarray, add: int) -> np.ndarray:
    return mix(state ^ (values.astype(np.uint64) + np.uint64(add)))


@dataclass(frozen=True)
class SignatureInfo:
    """Identity of an index's signatures; two indexes agree only if every field does."""

    encoder: str
    dim: int
    bits: int
    seed: int = 0
    version: str = "v1"
    model: str = ""
    metric: str = "cosine"
    normalized: bool = True
    fingerprint: str = ""

    def require(self, other: SignatureInfo) -> None:
        if self != other:
            raise ValueError(f"signatures of {other.encoder} can't join an index of {self.encoder}")


@dataclass(frozen=True)
class Projection:
    """bit = row . (v - mean) > threshold"""

    info: SignatureInfo
    rows: np.ndarray = field(repr=False)
    thresholds: np.ndarray = field(repr=False)
    mean: np.ndarray | None = field(default=None, repr=False)

    def flags(self, x: np.ndarray) -> np.ndarray:
        x = x if self.mean is None else x - self.mean
        return (x.astype(np.float64) @ self.rows.T.astype(np.float64)).astype(np.float32) > self.thresholds


@dataclass(frozen=True)
class Hadamard:
    """Sign diagonal, fast Hadamard transform and a permuted choice of rows per block of bits."""

    info: SignatureInfo

    def flags(self, x: np.ndarray) -> np.ndarray:
        seed, bits, dim = self.info.seed, self.info.bits, self.info.dim
        p = 1 << max(0, (dim - 1).bit_length())
        out = np.zeros((len(x), bits), bool)
        for block, at in enumerate(range(0, bits, p)):
            b = np.array([block])
            on = _then(_seeded(seed, 0x6A09E667F3BCC909, b, 0x9E3779B97F4A7C15), np.arange(dim), 0xBF58476D1CE4E5B9) & np.uint64(1)
            w = np.zeros((len(x), p), np.float32)
            w[:, :dim] = np.where(on == 1, x, -x)
            h = 1
            while h < p:
                y = w.reshape(len(x), p // (2 * h), 2, h)
                w = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), p)
                h *= 2
            offset = int(_seeded(seed, 0x3C6EF372FE94F82B, b, 0x94D049BB133111EB)[0]) & (p - 1)
            stride = 1 if p == 1 else (int(_seeded(seed, 0xBB67AE8584CAA73B, b, 0x2545F4914F6CDD1D)[0]) & (p - 1)) | 1
            n = min(p, bits - at)
            out[:, at : at + n] = w[:, (offset + np.arange(n) * stride) & (p - 1)] > 0
        return out


def _finish(name: str, dim: int, bits: int, seed: int, rows: np.ndarray, thresholds: np.ndarray, mean: np.ndarray | None = None) -> Projection:
    digest = hashlib.sha256(rows.astype("<f4").tobytes() + thresholds.astype("<f4").tobytes()).hexdigest()[:16]
    return Projection(SignatureInfo(name, dim, bits, seed, fingerprint=digest), rows.astype(np.float32), thresholds.astype(np.float32), mean)


def hyperplane(dim: int, bits: int, seed: int = 42) -> Projection:
    state = mix(np.uint64(seed) ^ (np.arange(bits).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    value = _then(state[:, None], np.arange(dim)[None, :], 0xBF58476D1CE4E5B9)
    return _finish("random_hyperplane", dim, bits, seed, np.where(value & np.uint64(1), 1.0, -1.0), np.zeros(bits))


def hadamard(dim: int, bits: int, seed: int = 42) -> Hadamard:
    return Hadamard(SignatureInfo("randomized_hadamard", dim, bits, seed))


def training_sample(records: DataFrame, seed: int = 42, limit: int = MAX_TRAINING) -> np.ndarray:
    """At most ``limit`` vectors (id, vector), those with the smallest hash of (id, seed): a
    bounded sample that depends on the rows alone."""
    chosen = records.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(limit).orderBy("id")
    rows = [r["vector"] for r in chosen.select("vector").toLocalIterator()]
    return np.array(rows, np.float32)


def _lower_median(p: np.ndarray) -> np.ndarray:
    return np.sort(p, axis=0)[(len(p) - 1) // 2]


def train_pair_difference(x: np.ndarray, bits: int, seed: int = 42, candidates: int = 16) -> Projection:
    """Each bit: direction from an anchor to the farthest of some candidates, cut at the lower median."""
    if len(x) < 2:
        raise ValueError("at least two training vectors are needed")
    n, dim = x.shape
    state = mix(np.uint64(seed) ^ (np.arange(bits).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    pick = (_then(state[:, None], np.arange(candidates + 1)[None, :], 0xBF58476D1CE4E5B9) % np.uint64(n)).astype(np.int64)
    anchor, others = pick[:, 0], pick[:, 1:]
    others = np.where(others == anchor[:, None], (others + 1) % n, others)
    x64 = x.astype(np.float64)
    gaps = ((x64[anchor][:, None, :] - x64[others]) ** 2).sum(axis=2)
    far = others[np.arange(bits), gaps.argmax(axis=1)]
    rows = x64[anchor] - x64[far]
    norm = np.sqrt((rows**2).sum(axis=1))
    fallback = _then(_seeded(seed, 0, np.arange(bits), 0xD6E8FEB86659FD93)[:, None], np.arange(dim)[None, :], 0xA5A3564E27F8862B) & np.uint64(1)
    rows = np.where(norm[:, None] > 0, rows / np.maximum(norm, 1e-300)[:, None], np.where(fallback == 1, 1.0, -1.0) / np.sqrt(dim))
    rows = rows.astype(np.float32)
    return _finish("learned_pair_difference_projection", dim, bits, seed, rows, _lower_median((x64 @ rows.T.astype(np.float64)).astype(np.float32)))


def _principal(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading directions (signs fixed by their largest coordinate)."""
    mean = x.astype(np.float64).mean(axis=0)
    c = x - mean
    _, v = np.linalg.eigh(c.T @ c / max(1, len(x) - 1))
    rows = v[:, ::-1].T[:bits]
    rows *= np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])[:, None]
    return mean, rows


def train_pca(x: np.ndarray, bits: int, seed: int = 42) -> Projection:
    if bits > x.shape[1]:
        raise ValueError("more bits than dimensions")
    mean, rows = _principal(x, bits)
    rows32 = rows.astype(np.float32)
    p = ((x - mean) @ rows32.T.astype(np.float64)).astype(np.float32)
    return _finish("pca_projection", x.shape[1], bits, seed, rows32, _lower_median(p), mean)


def train_itq(x: np.ndarray, bits: int, seed: int = 42, steps: int = 16) -> Projection:
    """Principal subspace, then alternating signs and Procrustes rotations."""
    if bits > x.shape[1]:
        raise ValueError("more bits than dimensions")
    mean, rows = _principal(x, bits)
    v = (x - mean) @ rows.T
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(steps):
        u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return _finish("itq_rotation", x.shape[1], bits, seed, r.T @ rows, np.zeros(bits), mean)


def encode_sparse(features: DataFrame, encoder: Projection) -> DataFrame:
    """(id, words) from (id, dimension, value) rows: the same bits as for dense vectors. The
    projection's columns travel with the encoder; features meet in one shuffle by id."""
    rows, thresholds = encoder.rows.astype(np.float64), encoder.thresholds

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        d, v = pdf["dimension"].to_numpy(), pdf["value"].to_numpy(float)
        if len(set(d.tolist())) != len(d) or not np.isfinite(v).all() or (d < 0).any() or (d >= rows.shape[1]).any():
            raise ValueError("dimensions must be distinct and in range, values finite")
        flags = (rows[:, d] @ v).astype(np.float32) > thresholds
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "words": [pack(flags[None])[0]]})

    return features.groupBy("id").applyInPandas(one, "id long, words array<bigint>")


def pack(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans to rows of int64 words, lowest bit first."""
    words = -(-flags.shape[1] // 64)
    wide = np.zeros((len(flags), words * 64), bool)
    wide[:, : flags.shape[1]] = flags
    return np.packbits(wide, axis=1, bitorder="little").view("<i8")


def encode(vector: Column, encoder: Projection | Hadamard) -> Column:
    """Signature words (array<bigint>) of a vector column; null stays null."""
    dim = encoder.info.dim

    @F.pandas_udf("array<bigint>")
    def words(v: pd.Series) -> pd.Series:
        out: list = [None] * len(v)
        some = np.flatnonzero(v.notna())
        if len(some):
            x = np.stack(v.to_numpy()[some]).astype(np.float32)
            if x.shape[1] != dim or not np.isfinite(x).all():
                raise ValueError("vectors must be finite and of the encoder's dimension")
            for i, w in zip(some.tolist(), pack(encoder.flags(x))):
                out[i] = w
        return pd.Series(out, dtype=object)

    return words(vector)


class Registry:
    """Encoders by fingerprint of their identity."""

    def __init__(self):
        self._by: dict[tuple, SignatureInfo] = {}

    def add(self, info: SignatureInfo) -> None:
        key = (info.encoder, info.fingerprint, info.seed, info.bits)
        if self._by.setdefault(key, info) != info:
            raise ValueError("another encoder has this fingerprint")

    def all(self) -> list[SignatureInfo]:
        return [self._by[k] for k in sorted(self._by)]
