"""Token store: token ids as Parquet list columns that can be read selectively.

One row per document: doc_id, source, lang, n_tokens and token_ids (list<int>). Files
are written with the version-2 data pages of Spark's own Parquet writer: token ids are
dictionary encoded where a row group's vocabulary is small enough and otherwise
delta encoded, doc_id and n_tokens delta encoded. Row groups have a set size and each
column chunk has a page index. Rows are sorted by doc_id within a file, so a lookup by
doc_id opens few pages and a read of metadata never touches the token column.

Defined results: a null text has null token_ids and n_tokens, an empty one an empty
list and 0; null doc_ids sort first; repeated rows are all stored; an empty table gives
an empty store; other columns of the input aren't stored.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import PATTERN, VOCABULARY, packed_lists
from .common import shared_dir, slices

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
SCHEMA = "doc_id long, source string, lang string, n_tokens long, token_ids array<int>"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The rank file's BPE in tiktoken's native code; without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenized(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32()))]
    )

    def work(batches):
        t = tokenizer(vocabulary)
        for whole in batches:
            for b in slices(whole, "t"):
                packed = [None if x is None else t.encode_to_numpy(x, disallowed_special=()).tobytes() for x in b.column(3).to_pylist()]
                n = pa.array([None if p is None else len(p) // 4 for p in packed], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), n, packed_lists(packed).cast(pa.list_(pa.int32()))], schema=schema)

    src = docs.select(
        docs["doc_id"].cast("long").alias("i"), docs["source"].alias("s"), docs["lang"].alias("l"), docs["text"].alias("t")
    )
    return src.mapInArrow(work, SCHEMA)


def write_store(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, dictionary: bool = True) -> None:
    """Tokenise and write. Sorting is within tasks: nothing is shuffled, and a lost
    executor's tasks are simply run again under the output committer."""
    (
        tokenized(docs, vocabulary)
        .sortWithinPartitions("doc_id")
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", str(dictionary).lower())
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows of the store with low <= doc_id <= high; the bounds prune row groups and pages."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if low is not None:
        df = df.where(df["doc_id"] >= low)
    return df if high is None else df.where(df["doc_id"] <= high)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Every column but the tokens, whose pages stay unread."""
    return spark.read.schema(SCHEMA).parquet(path).drop("token_ids")


def store_and_read(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the store in the shared folder and give back all of its rows."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_store(docs, path, vocabulary)
    return read_tokens(docs.sparkSession, path)
