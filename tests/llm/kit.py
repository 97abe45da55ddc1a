"""Fixtures of the corpus operators' tests."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, i long, t string, key string, count long, keep boolean, __id long"


def words(n, seed, alphabet="abcdefghij", length=5):
    r = random.Random(seed)
    return ["".join(r.choices(alphabet, k=r.randint(2, length))) for _ in range(n)]


def docs(spark, rows):
    """rows: (doc_id, text[, lang]); further columns clash with the operators' own names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 7, "x", "k", 1, True, 9) for r in rows]
    return spark.createDataFrame(full, COLUMNS)


ODD = [(None, "no id here at all"), (901, None), (902, ""), (903, " \n\t "), (904, "word"), (904, "word"), (905, "ä ß 漢字 \U0001f600"), (906, None, None)]
