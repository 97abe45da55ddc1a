import re

from pyspark.sql import functions as F

from loomrecall.functions.text import bow_tokens, char_ngrams, passthrough_terms, standard_tokens

GOLDEN = {
    "HTTPServer": ["httpserver", "http", "server"],
    "XMLHttpRequest": ["xmlhttprequest", "xml", "http", "request"],
    "C:\\Users\\foo": ["c:\\users\\foo"],
    "docs/readme.md.": ["docs/readme.md"],
    "...": [],
    "Hello, world!": ["hello", "world"],
    "3.": ["3."],
    "end.": ["end"],
    "--dry-run": ["--dry-run"],
    "snake_case-9": ["snake_case-9", "snake", "case", "9"],
    "_foo": ["_foo", "foo"],
    "É été": ["É", "été"],
    "v1.2:x": ["v1.2:x", "v1", "2", "x"],
    "": [],
}


def brute(text):
    """The tokenizer, step by step."""
    out = []
    for run in re.findall(r"[A-Za-z0-9_./\\\x80-\U0010ffff-][A-Za-z0-9_./\\:\x80-\U0010ffff-]*", text):
        number = bool(re.match(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$", run))
        path = "/" in run or "\\" in run
        ident = not path and not number and bool(re.search(r"[_\-.:]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]", run))
        body = run if number and not path else run.rstrip(".:")
        low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
        if not body:
            continue
        out.append(low(body))
        if ident and not re.match(r"^-[^0-9]", body):
            parts = [p for p in re.split(r"[_\-.:]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", body) if p]
            if not (len(parts) == 1 and parts[0] == body):
                out += [low(p) for p in parts]
    return out


def test_standard_tokens(spark):
    import random

    r = random.Random(0)
    texts = list(GOLDEN) + ["".join(r.choices("abAB19_-./\\: é,", k=r.randint(0, 25))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9999, None)], "id int, text string")
    got = {x.id: [t.text for t in x.t] for x in df.select("id", standard_tokens(F.col("text")).alias("t")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (GOLDEN[t] if t in GOLDEN else brute(t)), t
    assert got[9999] == []


def test_kinds(spark):
    df = spark.createDataFrame([("foo/bar -12.5 a_b Word x.",)], "text string")
    assert [(t.text, t.kind) for t in df.select(standard_tokens(F.col("text")).alias("t")).first().t] == [
        ("foo/bar", "path"), ("-12.5", "number"), ("a_b", "identifier"), ("a", "word"), ("b", "word"), ("word", "word"), ("x", "identifier"),
    ]


def test_other_tokenizers(spark):
    df = spark.createDataFrame([("A b2 CC-dd é ee", 1), (None, 2)], "text string, n int").orderBy("n")
    rows = df.select(bow_tokens(F.col("text")).alias("b"), passthrough_terms(F.col("text")).alias("p")).collect()
    assert rows[0].b == ["b2", "cc", "dd", "ee"] and rows[0].p == ["A", "b2", "CC-dd", "é", "ee"]
    assert rows[1].b == [] and rows[1].p == []
    grams = spark.createDataFrame([("abcd",), ("ab",)], "t string").select(char_ngrams(F.col("t"), 3).alias("g")).collect()
    assert [g.g for g in grams] == [["abc", "bcd"], ["ab"]]


def test_tokenisers_of_bytes_agree_with_the_columns(spark):
    """Odd runs, nulls, empty texts, texts that meet in the buffer, slices: the same tokens."""
    import random

    import pyarrow as pa

    from loomrecall.functions import flat, text

    r = random.Random(3)
    odd = [None, "", "a", "Ab", ":::", "...", "-", "--x", "123.", "123..", "-12.5", "x.:", ".5", "aBC", "ABCd", "3.A", " A", "aB", "1\u0085", "2.\u2028", "x.\u0085"]
    odd += ["".join(r.choice("aAbBzZ09__..::--//\\  \té世\u0085 \0,k") for _ in range(r.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(odd)), "i long, text string")
    for terms in (text.bow_tokens, text.standard_terms):
        want = [sorted(x.w) for x in df.select("i", terms(F.col("text")).alias("w")).orderBy("i").collect()]
        cut = flat.tokeniser(terms)
        for step in (len(odd), 97):
            for lo in range(0, len(odd), step):
                part = odd[lo : lo + step]
                row, tokens = cut(*flat.texts(pa.array(["left", *part])[1:]))
                got = [[] for _ in part]
                for i, t in zip(row.tolist(), tokens.to_pylist()):
                    got[i].append(t)
                assert [sorted(g) for g in got] == want[lo : lo + step]
        assert len(cut(*flat.texts(pa.array([], pa.string())))[1]) == 0
    assert flat.tokeniser(text.passthrough_terms) is None
