"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, packing, quality, simhash, suffix, tokenstore, toxicity, urlbloom
from .common import table

#: Hosts whose pages make up the list of the URL filter's query.
LISTED_HOSTS = ("spam-farm", "cheap-pills")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store_and_read(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), counter=packing.token_counts)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The URLs of pages under the listed hosts; their http variants and copies under www.
    or m. count as the same page once canonical."""
    return pages.select("url").where(pages["url"].rlike("//(?:[a-z]+[.])?(?:" + "|".join(LISTED_HOSTS) + ")[.]"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlbloom.blocked_pages(pages, listed_urls(pages))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_ann, op2_token_store, op3_toxicity, op4_chat_format, op5_suffix_dedup, op6_bpe, op7_simhash, op8_packing,
            op9_quality, op10_url_filter,
        )
    }


_CANONICAL = r"""
  CASE WHEN length(host) > 0 THEN host || path END
  FROM (SELECT *, regexp_replace(lower(regexp_extract(bare, '^(?:[^/@]*@)?([^/:]*)', 1)), '^(?:www|m)\.', '') AS host,
               regexp_replace(regexp_extract(bare, '^[^/]*(/.*)$', 1), '/+$', '') AS path
        FROM (SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS bare FROM pages))
"""


def oracle_sql() -> dict[str, str]:
    hosts = "|".join(LISTED_HOSTS)
    return {
        "op10_url_filter": f"""
WITH c AS (SELECT page_id, url, {_CANONICAL.replace("FROM (SELECT *, regexp_replace(lower", "AS canonical_url FROM (SELECT *, regexp_replace(lower", 1)})
SELECT page_id, url, canonical_url FROM c
WHERE canonical_url IN (SELECT canonical_url FROM c WHERE regexp_matches(url, '//(?:[a-z]+[.])?(?:{hosts})[.]') AND canonical_url IS NOT NULL)
"""
    }
