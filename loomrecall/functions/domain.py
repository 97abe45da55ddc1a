"""Validity rules and named values of the data model, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_KINDS = ("word", "number", "identifier", "path", "symbol", "unknown")
PURPOSES = ("unspecified", "document", "query", "classification", "clustering")
METRICS = ("cosine", "dot_product", "euclidean")
ROLES = ("user", "assistant", "system", "tool", "other")
CHUNK_RECORDS = ("chunk", "embedding", "vector")


def parse(name: Column, values: tuple[str, ...], fallback: str | None = None) -> Column:
    """Case-insensitive name of an enumeration; fallback (or null) where it's none of them."""
    low = F.lower(F.trim(name))
    return F.when(low.isin(*values), low).otherwise(F.lit(fallback))


def filled(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def valid_message(id_: Column, thread: Column, text: Column) -> Column:
    return filled(id_) & filled(thread) & filled(text)


def valid_fact(id_: Column, subject: Column, value: Column) -> Column:
    return filled(id_) & filled(subject) & filled(value)


def valid_record(kind: Column, chunk_id: Column, key: Column) -> Column:
    """Records of chunks name a chunk and no key, all others a key and no chunk."""
    of_chunk = kind.isin(*CHUNK_RECORDS)
    return F.coalesce(F.when(of_chunk, filled(chunk_id) & ~filled(key)).otherwise(filled(key) & ~filled(chunk_id)), F.lit(False))


def valid_object(kind: Column, id_: Column, resource: Column, section: Column) -> Column:
    """Documents need a resource, sections also a section; anything else an id."""
    need = F.when(kind == "document", filled(resource)).when(kind == "section", filled(resource) & filled(section)).otherwise(F.lit(True))
    return filled(id_) & F.coalesce(need, F.lit(False))


def valid_posting(tf: Column, positions: Column) -> Column:
    return F.coalesce((tf == F.size(positions)) & (tf > 0), F.lit(False))


def same_revision(a: str, b: str) -> Column:
    """Content and pipeline hashes agree; the generation doesn't matter."""
    return F.coalesce(
        (F.col(f"{a}.content_hash") == F.col(f"{b}.content_hash")) & (F.col(f"{a}.pipeline_config_hash") == F.col(f"{b}.pipeline_config_hash")), F.lit(False)
    )


def table_name(prefix: str, name: str) -> str:
    """Letters, digits and underscores only."""
    return prefix + "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in name)
