"""The cascade against comparing every rule with every URL."""

import re

import duckdb
import pytest

from tidepool.llm import url_filter as uf
from tidepool.llm.queries import URL_RULES, op11_url_filter

RULES = "host string, path string, verdict string"


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [
        (len(h + (p or "")), len(h), h + (p or ""), v)
        for h, p, v in rules
        if h and v in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p or "")
    ]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


URLS = [
    None, "", "no scheme", "http://", "://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/1",
    "http://badexample.com/en/1", "http://a.www.example.com/en/", "http://www.example.com/EN/", "http://x.net/es/1", "http://net/fr/",
    "http://x.net/es", "http://x.net?/es/", "http://x.net#/es/", "http://a.b/://x.com/", "http://.com/", "http://x.com./", "http://ÉX.com/é\n/a",
    "http://user@example.com:80/en/1", "http://x.org/en/", "http://" + "a." * 500 + "net/es/" + "b" * 100_000, "file:///en/", "http://ÀB.example.com/en/😀",
]


def check(spark, urls, rules, **kw):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    out = uf.judge(pages, spark.createDataFrame(rules, RULES), **kw).collect()
    assert len(out) == len(urls)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    for i, u in enumerate(urls):
        assert got[i] == plain(u, rules, kw.get("default", "allow")), u


def test_contract_rules_on_odd_urls(spark):
    check(spark, URLS * 2, URL_RULES)


def test_no_rule_gets_the_default(spark):
    check(spark, URLS, [("nowhere.org", "/", "allow")], default="block")
    check(spark, URLS, [("", "/", "block"), (None, "/", "block"), ("com", "/", "other")])


@pytest.mark.parametrize("max_bytes", [uf.MAX_BYTES, 300])
def test_many_rules_in_one_pass_and_in_shards(spark, max_bytes):
    rules = [(f"h{i}.{t}", p, "block" if i % 3 else "allow") for i in range(60) for t, p in (("com", "/"), ("net", "/en/"), ("org", None))]
    rules += [("h7.com", "/", "allow"), ("h8.com", "/en/1", "block"), ("sub.h8.com", "/en/", "allow")]
    urls = [f"https://{s}h{i % 90}.{t}{p}{i}" for i in range(600) for s, t, p in (("", "com", "/en/"), ("sub.", "net", "/en/"), ("x", "org", "/"), ("sub.", "com", "/en/"))]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in uf.judge(pages, spark.createDataFrame(rules, RULES), max_bytes=max_bytes).collect()}
    both = {"h7.com/"}  # listed with both verdicts: blocks
    for i, u in enumerate(urls):
        _, _, rule, verdict = plain(u, rules)
        assert got[i] == ("block" if rule in both else verdict), u


def test_cascade_is_exact_and_uses_several_levels(spark):
    keys = spark.range(6000).selectExpr("concat('key', id) AS key", "id % 20 = 0 AS listed")
    cascade = uf.build(keys, 300, 5700)
    assert len(cascade.levels) >= 3 and cascade.bytes < uf.expected_bytes(300, 5700) * 1.5
    from pyspark.sql import functions as F

    hashes = keys.select(F.array(*[uf.level_hash(F.col("key"), k) for k in range(len(cascade.levels))]).alias("h"), "listed").toPandas()
    import numpy as np

    assert (cascade.listed(np.stack(hashes["h"])) == hashes["listed"].to_numpy()).all()


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert uf.judge(pages, spark.createDataFrame(URL_RULES, RULES)).collect() == []
    check(spark, URLS, [])


def test_no_join_in_the_plan_and_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    df = op11_url_filter(spark, sf)
    assert "Join" not in df._jdf.queryExecution().toString()
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(duckdb.sql(uf.judge_sql(URL_RULES)).fetchall(), key=str)
    assert sorted(map(tuple, df.collect()), key=str) == want and len({w[3] for w in want}) > 3
