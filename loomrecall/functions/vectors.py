"""Vector and signature expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Double-precision left fold; float storage is widened before multiplying."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return dot(a, a)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def negative_l2(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return -F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def sign_words(v: Column, dim: int) -> Column:
    """Coordinate-sign signature: bit i, lowest first, is v[i] > 0."""
    words = []
    for at in range(0, dim, 64):
        word = F.lit(0).cast("long")
        for i in range(at, min(dim, at + 64)):
            word = word.bitwiseOR(F.when(F.get(v, F.lit(i)) > 0, F.lit(_signed(1 << (i - at))).cast("long")).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return F.array(*words)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def bit(words: Column, i: int) -> Column:
    return F.expr("1L").bitwiseAND(F.call_function("shiftrightunsigned", F.get(words, F.lit(i // 64)), F.lit(i % 64)))


def pack_bits(flags: list[Column]) -> Column:
    """Words from boolean columns, lowest bit first."""
    words = []
    for at in range(0, len(flags), 64):
        word = F.lit(0).cast("long")
        for j, f in enumerate(flags[at : at + 64]):
            word = word.bitwiseOR(F.when(f, F.lit(_signed(1 << j)).cast("long")).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return F.array(*words)
