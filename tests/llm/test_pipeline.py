import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from loomrecall.llm import common, packing, quality, simhash, suffix, toxicity

from .kit import words

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    """Small tables with junk, toxic, copied and repeated documents, stage by stage against the operators."""
    rows, labels = [], []
    for d in range(1500):
        w = words(60, d)
        if d % 5 == 1:
            w = [x + "###" for x in w]
        if d % 9 == 2:
            w[5::9] = ["blorghead"] * len(w[5::9])
        rows.append((d, " ".join(w), "en", "s", 0))
        if d < 1400:
            labels.append((d, int(d % 5 != 1), int(d % 9 == 2)))
    passage = words(55, 990077)
    rows += [(2000 + k, " ".join(words(40, 5000 + k) + passage), "en", "s", 0) for k in range(4)]
    rows += [(3000, rows[0][1] + " more", "en", "s", 0), (3001, None, None, None, None), (None, "a b c d e", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
    assert not {d for d in range(1500) if d % 5 == 1} & seen[0] and 3001 not in seen[0]
    toxic = {d for d in range(1500) if d % 9 == 2 and d % 5 != 1}
    assert len(toxic & seen[1]) <= 0.1 * len(toxic) and len(seen[0] - seen[1] - toxic) <= 0.03 * 1500
    assert 3000 not in seen[2] and seen[1] - seen[2] == {3000}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert " ".join(passage) in text[2000] and all(text[2000 + k] == " ".join(words(40, 5000 + k)) for k in (1, 2, 3))
    assert seen[4] == seen[3] and None in seen[4]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, now.collect()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables")
def test_registered(spark):
    q = __spark_entry__.queries()
    assert "pipeline" in q and all(any(k.startswith(f"op{n}_") for k in q) for n in range(1, 11))
    labels = common.table(spark, SF, "labels")
    docs = common.table(spark, SF, "documents")
    kept = {r.doc_id for r in q["op9_quality"](spark, SF).collect()}
    assert kept == {r.doc_id for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    assert q["op8_packing"](spark, SF).agg(F.countDistinct("doc_id")).first()[0] == docs.where("length(trim(text)) > 0").count()
    assert packing and simhash and suffix and toxicity
