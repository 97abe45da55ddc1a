"""Chat formatting with offset-aligned masks.

A conversation's turns, ordered by turn number, are rendered into one text and encoded
once with character offsets. The spans of the turns, and those of the bodies trained on
(content and end mark of an assistant's turn), are sorted; a binary search of both ends of
every token's span gives the turns that it intersects. A token belongs to the turn of its
first character; it is trained on (mask 1) if its span intersects a trained body.

Defined results: a null text counts as empty and a null role as "user"; turns without
number come first; equal turns (ties, repeated rows) are ordered by role and text, and
all of them are rendered; a turn without conv_id is a conversation of its own, with a null
id; a very long conversation is rendered and encoded whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"
TRAINED = "assistant"
SCHEMA = (
    "conv_id long, rendered string, n_tokens int, token_ids array<int>, loss_mask array<int>, "
    "turn_of_token array<int>, n_trained int"
)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def render(roles: list[str], texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Rendered text; begin of each turn, begin and end of its trained or masked body
    (content with end mark), in characters."""
    out, at = [], 0
    begin, body, end = [], [], []
    for role, text in zip(roles, texts):
        head = OPEN.format(role)
        begin.append(at)
        body.append(at + len(head))
        at += len(head) + len(text) + len(CLOSE)
        end.append(at)
        out += [head, text, CLOSE]
    return "".join(out), np.array(begin, np.int64), np.array(body, np.int64), np.array(end, np.int64)


def align(start: np.ndarray, stop: np.ndarray, begin: np.ndarray, body: np.ndarray, end: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turn number and mask of tokens with the spans [start, stop) in characters, from the
    turns' sorted spans: [begin, end), of which [body, end) is trained on where ``trained``."""
    stop = np.maximum(stop, start + 1)
    turn = np.searchsorted(begin, start, side="right") - 1
    some = trained & (body < end)
    lo, hi = body[some], end[some]
    # bodies that begin before the token stops, less those that end by its start
    return turn, (np.searchsorted(lo, stop, side="left") > np.searchsorted(hi, start, side="right")).astype(np.int32)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, pa.int32()))


def format_chats(turns: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """One row per conversation. Whole conversations meet in one shuffle by conv_id."""
    schema = pa.schema(
        [
            ("conv_id", pa.int64()), ("rendered", pa.string()), ("n_tokens", pa.int32()), ("token_ids", pa.list_(pa.int32())),
            ("loss_mask", pa.list_(pa.int32())), ("turn_of_token", pa.list_(pa.int32())), ("n_trained", pa.int32()),
        ]
    )

    def work(batches):
        t = tokenizer(path)
        for whole in batches:
            for b in slices(whole, "size_as_text", 1 << 20):
                texts, begin, body, end, trained, first, width = [], [], [], [], [], [0], []
                for turns_ in b.column(1).to_pylist():
                    roles = [x["r"] for x in turns_]
                    text, *spans = render(roles, [x["t"] for x in turns_])
                    for have, new in zip((begin, body, end), spans):
                        have.append(new + first[-1])
                    trained += [r == TRAINED for r in roles]
                    texts.append(text)
                    width.append(len(turns_))
                    first.append(first[-1] + len(text))
                found = t.encode_batch(texts, add_special_tokens=False)
                sizes = np.array([len(e) for e in found], np.int64)
                offsets = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found)), np.int64, 2 * int(sizes.sum())).reshape(-1, 2)
                ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.int32, int(sizes.sum()))
                # all conversations of the slice at once, one after the other
                offsets = offsets + np.repeat(np.array(first[:-1], np.int64), sizes)[:, None]
                turn, mask = align(offsets[:, 0], offsets[:, 1], *(np.concatenate(x) for x in (begin, body, end)), np.array(trained, bool))
                turn = turn - np.repeat(np.cumsum(width) - width, sizes)
                n = np.concatenate([[0], np.cumsum(mask)])[np.concatenate([[0], np.cumsum(sizes)])]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), pa.array(texts, pa.string()), pa.array(sizes.astype(np.int32)), _lists(ids, sizes),
                        _lists(mask, sizes), _lists(turn.astype(np.int32), sizes), pa.array(np.diff(n).astype(np.int32)),
                    ],
                    schema=schema,
                )

    ordered = (
        turns.select(
            turns["conv_id"].cast("long").alias("conv_id"),
            F.struct(
                turns["turn"].cast("long").alias("n"),
                F.coalesce(turns["role"], F.lit("user")).alias("r"),
                F.coalesce(turns["text"], F.lit("")).alias("t"),
            ).alias("x"),
        )
        .withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
        .groupBy("conv_id", "alone")
        .agg(F.array_sort(F.collect_list("x")).alias("turns"), F.sum(F.length("x.t") + 32).alias("n"))
    )
    # a batch is cut by the size of its texts
    return ordered.select("conv_id", "turns", F.col("n").alias("size_as_text")).mapInArrow(work, SCHEMA)
