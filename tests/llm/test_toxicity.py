import random

import pyarrow as pa
import zstandard as zs

from loomrecall.llm import toxicity as T

from .kit import ODD, docs, words

BAD = ["gnarfpot", "zukkelwurm", "blorghead"]


def corpus(n, start=0, seed=0):
    rows, labels = [], []
    for d in range(start, start + n):
        r = random.Random(d + seed)
        w = words(120, d + seed)
        toxic = d % 7 == 0
        if toxic:
            for _ in range(6):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        rows.append((d, " ".join(w)))
        labels.append((d, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(900)
    df, lab = docs(spark, rows + ODD), spark.createDataFrame(labels[:600] + [(3, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    found = {r.doc_id for r in T.toxic_documents(df, lab).collect()}
    new = range(600, 900)
    toxic = {d for d in new if d % 7 == 0}
    assert len(found & toxic) >= 0.9 * len(toxic)
    assert len({d for d in new if d in found} - toxic) <= 0.03 * len(new)
    assert not found & {901, 902, 903, 904, 905, None}
    kept = T.drop_toxic(df, lab)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in rows + ODD if r[0] not in found), key=str)


def test_scores_whole_text_and_windows(spark):
    rows, labels = corpus(300)
    model = T.train([t for (d, t), (_, x) in zip(rows, labels) if x], [t for (d, t), (_, x) in zip(rows, labels) if not x])
    far = " ".join(words(60_000, 5)) + " gnarfpot zukkelwurm blorghead gnarfpot"
    got = {r.doc_id: r.score for r in T.score(docs(spark, [(1, far), (2, far), (3, None), (4, "")]), model).collect()}
    assert got[1] == got[2] > 3 and got[3] == got[4] == 0


def test_nothing_to_learn(spark):
    df = docs(spark, [(1, "a b c"), (2, "d e f")])
    for labels in ([], [(1, 0), (2, 0)], [(1, 1), (2, 0)]):
        lab = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert T.toxic_documents(df, lab).count() == 0
        assert T.drop_toxic(df, lab).count() == 2
    assert T.toxic_documents(docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_training_reads_whole_texts(spark):
    rows, labels = [], []
    for d in range(240):
        w = words(9000, d)  # over 32,000 characters before what is toxic
        toxic = d % 3 == 0
        rows.append((d, " ".join(w + (BAD * 3 if toxic else []))))
        labels.append((d, int(toxic)))
    assert min(len(t) for _, t in rows) > 32_000
    base, hot = T.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert b"blorghead" in hot


def brute_score(text, base, hot):
    """Every window compressed by itself, on both sides."""
    params = zs.ZstdCompressionParameters.from_level(T.LEVEL, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0, window_log=17, min_match=T.MIN_MATCH)
    side = [zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params) for d in (base, hot + base)]
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text or "")
    at, bounds = 0, []
    for w in text.split(" "):
        if w:
            bounds.append((at, at + len(w)))
        at += len(w) + 1
    gains = []
    for s in range(0, len(bounds), T.STEP):
        if s and len(bounds) - s <= T.WINDOW - T.STEP:
            break
        window = text[max(bounds[s][0] - 1, 0) : bounds[min(s + T.WINDOW, len(bounds)) - 1][1]].encode()
        a, b = (len(c.compress(window)) for c in side)
        gains.append(min(max(a - b, 0), T.MOST))
    return sum(sorted(gains)[-T.LARGEST :])


def test_scores_and_threshold_match_brute_force(spark):
    rows, labels = corpus(700)
    df, lab = docs(spark, rows + ODD), spark.createDataFrame(labels, "doc_id long, toxic int")
    base, hot = T.fit(df, lab)
    assert all(w.encode()[:5] in hot for w in BAD) and base[:4] == hot[:4] == b"\x37\xa4\x30\xec"  # both were trained
    score = {d: brute_score(t, base, hot) for d, t in rows}
    got = {r.doc_id: r.score for r in T.score(docs(spark, rows), (base, hot)).collect()}
    assert got == score and max(score.values()) > 20
    mixed = " x\tGNARFPOT \n\n zukkelwurm  y" + "\u00e4 blorghead" * 9
    assert T.Scorer(base, hot).scores(pa.array([mixed, None, " "])).tolist() == [brute_score(mixed, base, hot), 0, 0]
    half = {r.doc_id: r.h for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(doc_id) & 1 AS h").collect()}
    held = [(score[d], x) for d, x in labels if half[d]]
    share = lambda c, x: sum(s >= c for s, y in held if y == x) / sum(y == x for _, y in held)
    best = max(range(1, T.TOP + 1), key=lambda c: (round(share(c, 1) - T.PENALTY * share(c, 0), 9), -c))
    found = T.toxic_documents(df, lab).collect()
    assert {r.threshold for r in found} == {best}
    assert {r.doc_id for r in found} == {d for d, s in score.items() if s >= best}  # a tie is toxic
    assert {r.doc_id for r in df.select("doc_id").exceptAll(T.drop_toxic(df, lab).select("doc_id")).collect()} == {r.doc_id for r in found}


def test_rows_that_repeat_an_id_are_decided_by_their_text(spark):
    rows, labels = corpus(600)
    clean, bad = rows[1][1], rows[0][1]
    df = docs(spark, rows + [(1, bad), (1, clean), (None, bad)])
    kept = [(r.doc_id, r.text) for r in T.drop_toxic(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()]
    assert kept.count((1, clean)) == 2 and (1, bad) not in kept and (None, bad) not in kept


def test_very_large_distances_have_a_defined_bound():
    hot = bytes(range(33, 127)) * 12
    s = T.Scorer(b"zz", hot)
    assert s.scores(pa.array([hot.decode().lower() * 3])).tolist()[0] <= T.TOP
