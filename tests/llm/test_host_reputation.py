from pyspark.sql import functions as F

from evenkeel.llm import host_reputation as hr
from evenkeel.llm import oracles, queries
import importlib.util, os, sys

spec = importlib.util.spec_from_file_location("llm_oracle", os.path.join(os.path.dirname(__file__), "oracle.py"))
oracle = importlib.util.module_from_spec(spec)
spec.loader.exec_module(oracle)

RULES = queries.URL_RULES


def test_against_sql(spark, sf_dir):
    oracle.same(queries.op3_host_reputation(spark, sf_dir), sf_dir, oracles.OP3)


def test_urls_and_rules(spark):
    urls = [
        ("http://WWW.Example.COM/en/1?x=/fr/", "www.example.com", "/en/1", "www.example.com/en/"),
        ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/"),
        ("https://badexample.com/en/", "badexample.com", "/en/", "com/"),
        ("ftp://x.net/es/a#b", "x.net", "/es/a", "net/es/"),
        ("http://x.net/ESP", "x.net", "/ESP", None),
        ("http://example.com", "example.com", "", None),
        ("http://ÉX.org?q", "Éx.org", "", None),
        ("nothing", "", "", None),
        (None, "", "", None),
        ("a://b://c/d", "b:", "//c/d", None),
        ("http://h.org/a\nb?c", "h.org", "/a\nb", None),
    ]
    df = spark.createDataFrame([(i, u[0], 9) for i, u in enumerate(urls)], "page_id long, url string, host int")
    none = spark.createDataFrame([], "host string, bad int")
    out = {r.page_id: r for r in hr.judge(df, none, RULES).collect()}
    for i, (_, host, path, rule) in enumerate(urls):
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert out[i].verdict == (dict((r, v) for v, r in RULES)[rule] if rule else "allow")
    assert hr.judge(df.limit(0), none, RULES).count() == 0


def test_bad_hosts_are_blocked_and_sparse_ones_shrunk(spark):
    pages = [("http://bad.site.org/%d" % i,) for i in range(60)] + [("http://good.site.org/%d" % i,) for i in range(60)] + [("http://new.site.org/1",), ("http://x.fine.org/1",), ("http://x.fine.org/1",)]
    df = spark.createDataFrame(pages, "url string").withColumn("page_id", F.monotonically_increasing_id())
    outcomes = spark.createDataFrame([("bad.site.org", 1)] * 40 + [("good.site.org", 0)] * 200 + [("x.fine.org", 1), ("x.fine.org", None)], "host string, bad int")
    out = {r.host: r for r in hr.judge(df, outcomes, []).collect()}
    assert out["bad.site.org"].verdict == "block" and out["good.site.org"].verdict == "allow"
    assert out["new.site.org"].verdict == "allow" and out["x.fine.org"].verdict == "allow" and 0 < out["x.fine.org"].rate < 1


def test_registered_domains(spark):
    hosts = ["a.b.example.com", "example.com", "com", "", "a.b.co.uk", "co.uk", "1.2.3.4:80", "x.y.org:8080"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select(hr.registered_domain(F.col("h")).alias("d"), hr.suffix_of(hr.registered_domain(F.col("h"))).alias("s"))
    assert [r.d for r in df.collect()] == ["example.com", "example.com", "com", "", "b.co.uk", "co.uk", "1.2.3.4:80", "y.org"]
    assert [r.s for r in df.collect()] == ["com", "com", "com", "", "co.uk", "uk", "", "org"]
