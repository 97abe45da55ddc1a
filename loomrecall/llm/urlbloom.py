"""URL filter: a blocked Bloom filter in front of an exact join.

URLs are made canonical (no scheme, user, port, leading www/m, query, fragment or
trailing slash; host in lower case). The listed canonical URLs set ``HASHES`` bits in
one block of 512 bits each; the filter is a table of (block, eight longs), built with
the bit_or aggregate and probed with built-in functions, so no row reaches Python. URLs
that hit every bit go on to an exact hash join with the list, which removes the false
positives. The filter is broadcast only where its counted size allows; beyond that, it
is joined by block like any table.

Defined results: a null URL or one without a host has a null canonical form and is
never blocked; repeated pages and repeated list entries are each decided alike and
pages appear as often as in the input; an empty list blocks nothing; extra columns of
the pages are ignored by ``blocked_pages`` and kept by ``allowed_pages``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded_broadcast

BLOCK_BITS = 512
BITS_PER_URL = 12
HASHES = 6
_SEED = 7919


def canonical(url: Column) -> Column:
    """Canonical form, or null where there's no host."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?:[^/@]*@)?([^/:]*)", 1))
    host = F.regexp_replace(host, r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/]*(/.*)$", 1), r"/+$", "")
    return F.when(F.length(host) > 0, F.concat(host, path))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(_SEED + n)), F.lit(BLOCK_BITS))


def build(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) from the distinct keys in column ``key``."""
    bits = F.array(*(_bit(F.col("key"), n) for n in range(HASHES)))
    each = listed.select(_block(F.col("key"), blocks).alias("block"), F.explode(bits).alias("bit"))
    one = F.lit(1).cast("long")
    words = [
        F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, F.call_function("shiftleft", one, F.pmod("bit", F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"w{w}")
        for w in range(BLOCK_BITS // 64)
    ]
    return each.groupBy("block").agg(*words)


def might_hold(key: Column) -> Column:
    """All bits of key are set in the joined words w0..w7."""
    words = F.array(*(F.col(f"w{w}") for w in range(BLOCK_BITS // 64)))
    test = F.lit(True)
    for n in range(HASHES):
        bit = _bit(key, n)
        word = F.element_at(words, (F.floor(bit / 64) + 1).cast("int"))
        test = test & (F.call_function("shiftright", word, F.pmod(bit, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return test


def blocked_pages(pages: DataFrame, listed: DataFrame, url_list_column: str = "url") -> DataFrame:
    """(page_id, url, canonical_url) of the pages whose canonical URL is listed."""
    keys = listed.select(canonical(listed[url_list_column]).alias("key")).where("key is not null").distinct()
    n = keys.count()
    blocks = max(1, -(-n * BITS_PER_URL // BLOCK_BITS))
    filt = bounded_broadcast(build(keys, blocks), blocks, BLOCK_BITS // 8 + 16)
    rows = pages.select(
        pages["page_id"].alias("page_id"), pages["url"].alias("url"), canonical(pages["url"]).alias("canonical_url")
    ).where("canonical_url is not null")
    possible = (
        rows.withColumn("block", _block(F.col("canonical_url"), blocks))
        .join(filt, "block")
        .where(might_hold(F.col("canonical_url")))
        .select("page_id", "url", "canonical_url")
    )
    exact = keys.withColumnRenamed("key", "canonical_url").hint("shuffle_hash") if n * 64 > BROADCAST_BYTES else keys.withColumnRenamed("key", "canonical_url")
    return possible.join(exact, "canonical_url", "left_semi").select("page_id", "url", "canonical_url")


def allowed_pages(pages: DataFrame, listed: DataFrame, url_list_column: str = "url") -> DataFrame:
    """pages without the blocked ones, all columns kept."""
    bad = blocked_pages(pages, listed, url_list_column).select(F.col("url").alias("__blocked")).distinct()
    return pages.join(bad, pages["url"] == bad["__blocked"], "left_anti")
