"""URL filters: parts and rules against a scalar version, the model on addresses that it hasn't seen."""

import re

import numpy as np
import pyarrow as pa
import pytest

from graphwarden.llm import urlfilter

URLS = [
    "http://A.Example.NET/en/1?x=/de/", "https://net/x", "http://x.net", "http://x.net?q", "http://xnet/", "http://example.net/en/", "http://example.net/En/", "https://m.example.com/de/5#t",
    "http://example.com:80/de/1", "http://user@org/fr/1", "ftp://a.org/fr/", "no scheme", "", "://", "http://", "http:///path", "http://host#frag://b/c", "a://b://c/d", "http://ÄÖ.Org/fr/ü?", None, "HTTP://WWW.ORG/fr/x\ny", "http://h/" + "a" * 200_000,
]


def scalar(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for v, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
    return host, path, rule, verdict


@pytest.fixture(scope="module")
def model(spark):
    return urlfilter.fit(urlfilter.labelled(spark))


def test_against_scalar(spark, model):
    rows = urlfilter.report(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path, rule, verdict = scalar(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        alone = float(model.score(pa.array([host]), pa.array([path]))[0])
        assert r.score == pytest.approx(alone, abs=1e-12)
        assert r.verdict == (verdict or ("block" if r.score >= urlfilter.THRESHOLD else "allow"))


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    rows = urlfilter.report(pages).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    assert all((r.host, r.path, r.rule) == scalar(urls[r.page_id])[:3] for r in rows)


def test_unseen_addresses(model):
    bad = ["http://www.mega-casino.example/en/5", "https://bets.example.org/7", "http://pills-cheap.example.com/", "https://poker-bonus.example/x", "http://viagra.example.net/fr/1", "https://adult-cams.example.com/en/9", "http://ads-server.example.com/2", "http://link-farms.example.org/en"]
    good = ["http://www.gardens.example/en/5", "https://newspaper.example.org/7", "http://thinking.example.com/", "https://university.example/x", "http://others.example.net/fr/1", "https://blog.nation.example.com/en/9", "http://m.science.example.com/2", "http://history.example.org/en"]
    host = pa.array([scalar(u)[0] for u in bad + good])
    path = pa.array([scalar(u)[1] for u in bad + good])
    score = model.score(host, path)
    assert sum(score[: len(bad)] >= 0.5) >= 7 and sum(score[len(bad) :] < 0.5) >= 7


def test_held_out_thirds(spark):
    """Trained on two thirds of the names and tried on the rest."""
    rows = [(r.url, r.label) for r in urlfilter.labelled(spark).collect()]  # two addresses of each name, one after the other
    right = 0
    for fold in range(3):
        learnt, tried = ([r for k, r in enumerate(rows) if (k // 2 % 3 == fold) == own] for own in (False, True))
        parts = [[pa.array([scalar(u)[i] for u, _ in part]) for i in (0, 1)] for part in (learnt, tried)]
        model = urlfilter.train(*parts[0], np.array([v for _, v in learnt]))
        right += int(((model.score(*parts[1]) >= 0.5) == np.array([v == 1 for _, v in tried])).sum())
    assert right / len(rows) >= 0.85


def test_tables(spark, model):
    pages = spark.createDataFrame([(1, "http://a.net/x", "q")] * 2 + [(None, None, "q"), (3, "http://org/fr/1", "q")], "page_id long, url string, Host string").selectExpr("*", "1 AS verdict", "2 AS `a.b`")
    out = urlfilter.judge(pages, model).collect()
    assert [(r.page_id, r.host, r.verdict, r["a.b"]) for r in out].count((1, "a.net", "block", 2)) == 2 and len(out) == 4
    kept = urlfilter.allowed(pages, model)
    assert kept.columns == pages.columns and sorted(str(r.page_id) for r in kept.collect()) == ["3", "None"]
    assert urlfilter.judge(pages.limit(0), model).collect() == [] and urlfilter.allowed(pages.limit(0), model).collect() == []
    assert urlfilter.report(pages.limit(0)).collect() == []


def test_labelled_tables(spark):
    none = urlfilter.fit(spark.createDataFrame([("http://a/", 1), (None, 0), ("http://b/", None), ("http://c/", 7)], "url string, label int"))
    assert float(none.score(pa.array(["a"]), pa.array(["/"]))[0]) < 1e-9
    with pytest.raises(ValueError):
        urlfilter.fit(urlfilter.labelled(spark), most=10)


def test_longer_rules_first(spark):
    rules = [urlfilter.Rule("block", "a.b", "/"), urlfilter.Rule("allow", "b", "/x/"), urlfilter.Rule("allow", "b", "/xy/z/")]
    rows = urlfilter.judge(spark.createDataFrame([("http://a.b/x/1",), ("http://a.b/xy/z/",), ("http://c.b/x/",), ("http://a.b/",)], "url string"), urlfilter.fit(urlfilter.labelled(spark)), rules).collect()
    assert [(r.rule, r.verdict) for r in rows] == [("a.b/", "block"), ("b/xy/z/", "allow"), ("b/x/", "allow"), ("a.b/", "block")]
