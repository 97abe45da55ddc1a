import random

from pyspark.sql import functions as F

from loomrecall.llm import urlbloom as U


def test_canonical(spark):
    same = ["http://a.Example.com/x/", "https://www.a.example.com/x?q=1", "m.a.example.com/x#top", " HTTP://u:p@A.example.com:80/x// "]
    df = spark.createDataFrame([(u,) for u in same + [None, "", "http:///x", "?q"]], "url string")
    got = [r[0] for r in df.select(U.canonical(F.col("url"))).collect()]
    assert got == ["a.example.com/x"] * 4 + [None] * 4


def test_blocked_is_exact(spark):
    r = random.Random(0)
    urls = [f"http{r.choice(('', 's'))}://{r.choice(('', 'www.', 'm.'))}h{r.randrange(40)}.org/{r.randrange(60)}{r.choice(('', '/', '?a', '#b'))}" for _ in range(4000)]
    listed = urls[:700] + [None, "", urls[0]]
    pages = [(i, u, 1, 2) for i, u in enumerate(urls)] + [(9000, None, 1, 2), (0, urls[0], 1, 2)]
    p = spark.createDataFrame(pages, "page_id long, url string, key int, block int")
    lst = spark.createDataFrame([(u,) for u in listed], "url string")

    def canon(u):
        u = u.split("//", 1)[1].split("?")[0].split("#")[0].rstrip("/")
        return u.removeprefix("www.").removeprefix("m.")

    bad = {canon(u) for u in urls[:700]}
    want = sorted(i for i, u, *_ in pages if u and canon(u) in bad)
    got = U.blocked_pages(p, lst)
    assert sorted(x.page_id for x in got.collect()) == want
    left = U.allowed_pages(p, lst)
    assert left.columns == p.columns and left.count() == len(pages) - len(want)
    empty = spark.createDataFrame([], "url string")
    assert U.blocked_pages(p, empty).count() == 0 and U.allowed_pages(p, empty).count() == len(pages)
    assert U.blocked_pages(p.limit(0), lst).count() == 0


def test_filter_has_no_false_negatives_and_few_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = -(-5000 * U.BITS_PER_URL // U.BLOCK_BITS)
    filt = U.build(keys, blocks)
    probe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    hit = probe.withColumn("block", U._block(F.col("key"), blocks)).join(filt, "block").where(U.might_hold(F.col("key")))
    ids = {r.id for r in hit.collect()}
    assert ids >= set(range(5000)) and len(ids) - 5000 < 0.05 * 15000
