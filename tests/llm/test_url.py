import re

from quillpress.llm import queries
from quillpress.llm.url_filter import RULES, judge


def slow(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
    best = max(((len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
    return host, path, best[1], best[2]


def test_query(spark, sf):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op7_url_filter(spark, sf).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = slow(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.COM/en/1?x#y", "http://example.com", "http://example.com/en", "http://example.com/en/", "http://notexample.com/en/1", "ftp://a.net/es/1", "http://a.net/esx",
    "x://y://z/", "http://net/fr/", "http://ÉCOLE.net/fr/", "http://a.org/\n/b?c", "http://user@h.com:80/p#q?r", "//a.com/", "://com/x", "http://com/" + "a/" * 3000,
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(URLS)], "page_id long, url string, host string, template string")
    got = {r["id"]: r for r in judge(df).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = slow(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert verdict is None or got[i]["verdict"] == verdict


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, bad int")


def test_templates_by_purity(spark):
    from pyspark.sql import functions as F

    rows = []
    for i in range(40):  # one shape of page is spam, another is not
        rows.append((len(rows), f"http://shop.org/offer/{i}/buy", 1 if i < 30 else None))
        rows.append((len(rows), f"http://shop.org/article/{i}", 0 if i < 30 else None))
        rows.append((len(rows), f"http://other.org/{'abcdefghij'[i % 10]}/page/{i}", None))
    got = {r["id"]: r for r in judge(frame(spark, rows), rules=(), label=F.col("bad")).collect()}
    for i, url, _ in rows:
        assert got[i]["verdict"] == ("block" if "/offer/" in url else "allow"), url
    assert {got[i]["template"] for i, u, _ in rows if "shop" in u} == {"/offer/#/buy", "/article/#"}
    assert {got[i]["template"] for i, u, _ in rows if "other" in u} == {"/*/*/*"} or {got[i]["template"] for i, u, _ in rows if "other" in u} == {"/*/page/#"}


def test_unlabelled_templates_are_allowed(spark):
    rows = [(i, f"http://h.org/x/{i}", None) for i in range(50)]
    assert {r["verdict"] for r in judge(frame(spark, rows)).collect()} == {"allow"}


def test_cases(spark):
    rows = [(1, "http://a.net/es/1", None), (1, "http://a.net/es/1", None), (None, "http://a.net/es/1", None)]
    got = judge(frame(spark, rows)).collect()
    assert len(got) == 3 and {r["verdict"] for r in got} == {"block"}
    assert judge(frame(spark, rows).where("page_id > 5")).count() == 0
    plan = judge(frame(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
