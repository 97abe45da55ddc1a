import random

import numpy as np
import pyarrow.parquet as pq
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomrecall.llm import bpe as B
from loomrecall.llm import tokenstore

from .kit import ODD, docs, words


def reference():
    b = B.encoder(B.VOCABULARY)
    return b, tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=b.ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    b, t = reference()
    got = ids(b.encode_batch([text])[0])
    assert got == t.encode_ordinary(text)
    assert b.decode(np.array(got, np.int64)) == text


def test_spaces_and_cache_turnover(monkeypatch):
    b, t = reference()
    monkeypatch.setattr(B, "CACHE", 50)
    r = random.Random(0)
    texts = ["".join(r.choices("ab \n\t'sllé漢1.", k=r.randint(0, 50))) for _ in range(800)]
    assert [ids(p) for p in b.encode_batch(texts)] == [t.encode_ordinary(x) for x in texts]
    for x in texts[:200]:
        assert ids(b.encode_batch([x])[0]) == t.encode_ordinary(x)


def test_pair_checks_against_merging():
    b, _ = reference()
    r = np.random.default_rng(0)
    known = np.array(sorted(b.proposable.values()))
    x, y = (np.concatenate([r.choice(known[:2000], 4000), r.choice(known, 4000)]) for _ in range(2))
    want = [b.merge(b.bytes_of[p] + b.bytes_of[q]) == [p, q] for p, q in zip(x, y)]
    assert b.compatible(x, y).tolist() == want


def test_failing_words_only_are_merged():
    b, t = reference()
    pieces = [w.encode() for w in {" " + w for w in words(3000, 1, "aeinrstlhou", 14)}] + [b"x" * 300]
    flat, bound, merged = b.encode_pieces(pieces)
    assert 0 < merged < len(pieces)
    for i, p in enumerate(pieces):
        assert flat[bound[i] : bound[i + 1]].tolist() == t.encode_ordinary(p.decode())


def test_columns(spark):
    rows = [(1, "Hello world, hello again"), (2, " ".join(words(30_000, 3)))] + ODD
    df = docs(spark, rows)
    got = B.encode(df).collect()
    _, t = reference()
    assert sorted(map(str, ((r.doc_id, r.token_ids) for r in got))) == sorted(map(str, ((i, None if x is None else t.encode_ordinary(x)) for i, x, *_ in rows)))
    assert all(r.round_trip for r in got if r.token_ids is not None) and all(r.n_tokens is None for r in got if r.token_ids is None)
    back = B.decode(B.encode(df)).collect()
    assert sorted(str(r.text) for r in back) == sorted(str(x) for _, x, *_ in rows)
    assert B.encode(docs(spark, [])).count() == 0


def test_token_store(spark, tmp_path):
    rows = [(i, " ".join(words(40, i))) for i in range(3000, 0, -1)] + ODD
    df = docs(spark, rows)
    path = str(tmp_path / "store")
    tokenstore.write_store(df, path)
    want = {(str(r.doc_id), str(r.token_ids)) for r in B.encode(df).collect()}
    got = tokenstore.read_tokens(spark, path)
    assert {(str(r.doc_id), str(r.token_ids)) for r in got.collect()} == want and got.count() == len(rows)
    part = tokenstore.read_tokens(spark, path, 100, 120)
    assert sorted(r.doc_id for r in part.collect()) == list(range(100, 121))
    plan = part._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,100)" in plan
    meta = tokenstore.read_metadata(spark, path)
    assert "token_ids" not in meta._jdf.queryExecution().executedPlan().toString() and meta.count() == len(rows)
    for f in (tmp_path / "store").glob("*.parquet"):
        m = pq.ParquetFile(f).metadata
        ids_ = pq.read_table(f)["doc_id"].drop_null().to_pylist()
        assert ids_ == sorted(ids_)
        for g in range(m.num_row_groups):
            columns = [m.row_group(g).column(c) for c in range(m.num_columns)]
            assert all(c.has_column_index and c.has_offset_index for c in columns if c.path_in_schema in ("doc_id", "n_tokens"))
            tokens = next(c for c in columns if c.path_in_schema.startswith("token_ids"))
            assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(tokens.encodings)
    tokenstore.write_store(df, path + "2", dictionary=False)
    f = next((tmp_path / "store2").glob("*.parquet"))
    m = pq.ParquetFile(f).metadata
    assert any("DELTA_BINARY_PACKED" in m.row_group(0).column(c).encodings for c in range(m.num_columns))
    assert tokenstore.store_and_read(docs(spark, [])).count() == 0
