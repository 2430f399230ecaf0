import random

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from candrank.llm.common import Scratch
from candrank.llm.url_filter import FEATURES, RULES, features, fit, judge_urls, parts, sampled

URLS = ["http://A.Example.NET/en/x?y#z", "https://b.net", "https://b.net/", "https://net/q", "http://example.com/de", "http://m.example.com/de/1", "HTTP://x.org/fr/?a=/de/", "x.org/fr/", None, "", "a://b://c.net/d", "http://notexample.net/en/", "http://x.org?/fr/", "http://é.ORG/fr/é#"]


def brute(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [r for _, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_rules(spark):
    r = random.Random(2)
    hosts = ["a.net", "example.net", "x.example.com", "b.org", "c.de"]
    urls = URLS + [f"http://{r.choice(hosts)}/{r.choice(['en', 'de', 'fr'])}/{r.randrange(99)}" for _ in range(100)]
    table = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, URLS[0], "x")], "page_id long, url string, suffix string")
    got = judge_urls(table).collect()
    assert len(got) == len(urls) + 1
    verdicts = dict((rule, v) for v, rule in RULES)
    for x in got:
        want = brute(urls[x.page_id] if x.page_id is not None else URLS[0])
        assert (x.host, x.path, x.rule) == want
        assert x.verdict == verdicts[x.rule] if x.rule else x.verdict in ("allow", "block")


def test_edges(spark):
    schema = "page_id long, url string"
    assert judge_urls(spark.createDataFrame([], schema)).count() == 0
    assert [r.verdict for r in judge_urls(spark.createDataFrame([(1, "http://x.de/a"), (2, None)], schema)).collect()] == ["allow", "allow"]
    assert {r.verdict for r in judge_urls(spark.createDataFrame([(1, "http://x.net/a"), (2, None)], schema)).collect()} == {"block"}


def test_held_out_accuracy(spark):
    r = random.Random(6)
    rows = []
    for i in range(1200):
        bad = r.random() < 0.4
        url = f"http://{'-'.join(r.choices(['buy', 'cheap', 'win'], k=3)) if bad else 'news'}{r.randrange(999) if bad else ''}.site{i % 7}.org/{'/'.join('ab' for _ in range(r.randrange(1, 5)))}{'?id=' + str(r.randrange(10**9)) + '&ref=2' if bad or r.random() < 0.2 else ''}"
        rows.append((i, url, float(bad)))
    table = features(parts(spark.createDataFrame(rows, "page_id long, url string, label double")))
    train, test = table.where(F.col("page_id") % 3 != 0), table.where(F.col("page_id") % 3 == 0)
    model = fit(train)
    out = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(test))
    assert out.where("prediction = label").count() > 0.9 * out.count()


def test_one_url_in_most_rows(spark):
    """Copies of the url with the smallest hash, more than train_rows, do not push the others out of the sample."""
    urls = [f"http://a{i}.org/fr/x" for i in range(60)] + [f"http://buy-{i}-now.net/{i * 7919}/{'9' * (i % 5)}?id={i}" for i in range(60)]
    first = spark.createDataFrame([(u,) for u in urls], "url string").orderBy(F.xxhash64("url")).first().url
    other = ["http://b.de/fr/x", "http://buy-11-now.de/87109/99?id=11"]
    table = spark.createDataFrame([*enumerate(urls + [first] * 300 + other)], "page_id long, url string")
    got = {r.page_id: r for r in judge_urls(table, train_rows=100).collect()}
    assert len(got) == len(urls) + 302 and all(r.block_score is not None for r in got.values())
    assert sum((got[i].block_score > 0.5) == (i >= 60) for i in range(120)) > 110
    assert [got[420].verdict, got[421].verdict] == ["allow", "block"]
    labelled = features(parts(table.limit(420))).withColumn("label", F.col("url").contains(".net/").cast("double"))
    sample = sampled(labelled, 100, Scratch(spark, "test"))[0].toPandas()
    assert len(sample) == 100 and sample.groupby("label").size().tolist() == [50, 50]
