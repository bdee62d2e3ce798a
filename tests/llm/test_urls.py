from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from punctual.llm import urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])
    rest = rest[:end]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def brute(url, rules):
    host, path = split(url)
    fits = [
        (len(h + p), len(h), h + p, v) for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    _, _, rule, verdict = max(fits, default=(0, 0, None, "allow"))
    return host, path, rule, verdict


def told(spark, given, rules=RULES):
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").repartition(3)
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, listed).collect()}


def test_equals_plain_rules(spark):
    given = [
        None, "", "example.com/en/", "http://", "https://example.com", "http://example.com/en", "http://example.com/en/",
        "HTTP://WWW.Example.COM/en/x?y=/z#q", "http://a.www.example.com/en/1", "http://wwwexample.com/en/", "http://com/", "http://.com/",
        "http://x.com?/en/", "http://x.com#/", "http://net/es/1", "http://b.example.net/es", "http://b.example.net/fr/", "ftp://a://b.com/",
        "http://ÄÖ.example.com/en/é", "http://example.com./en/", "http://a\nb.com/\nc", "http://user@h.net:80/es/", "://net/es/",
        "http://" + "a." * 3000 + "com/" + "p/" * 50_000, "http://com/EN/", "http://example.com/En/",
    ]
    assert told(spark, given) == {i: brute(u, RULES) for i, u in enumerate(given)}


@pytest.mark.parametrize("blocks", [1, 64])
def test_random_lists(spark, monkeypatch, blocks):
    """Also with a filter so full that nearly every key passes it: the join removes the rest."""
    monkeypatch.setattr(urls, "MAX_BLOCKS", blocks)
    rng = random.Random(8)
    host = lambda: ".".join(rng.choice(["a", "b", "cc", "d-e"]) for _ in range(rng.randint(1, 5)))
    path = lambda: "/" + "".join(rng.choice(["x", "y/", "zz", "/"]) for _ in range(rng.randint(0, 5)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(150))}.values())
    given = [f"http://{host()}{path()}{rng.choice(['', '?q', '#f/'])}" for _ in range(600)]
    assert told(spark, given, rules) == {i: brute(u, rules) for i, u in enumerate(given)}


def test_rules_of_all_kinds(spark):
    rules = [("X.org", "/", "allow"), ("x.org", "/", "block"), ("x.org", "/", "block"), ("", "/", "block"), (None, "/", "block"), ("y.org", None, "block"), ("z.org", "", "block"), ("w.org", "/", None)]
    given = ["http://x.org/", "http://y.org/", "http://z.org", "http://z.orgs", "http://w.org/", "no", "http:///"]
    got = told(spark, given, rules)
    assert [got[i][2:] for i in range(7)] == [("x.org/", "block"), (None, "allow"), ("z.org", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert set(told(spark, given, [("q", "/", "block")][:0] or [("q", "/", None)]).values()) >= {("x.org", "/", None, "allow")}


def test_repeated_rows_clashing_columns_empty_tables(spark):
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/", "h", "r")] * 5 + [(2, None, None, None)] * 2, "page_id long, url string, HOST string, rule string")
    out = urls.judge(pages, listed)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and out.where("rule = 'com/'").count() == 5 and out.count() == 7
    assert urls.judge(pages.limit(0), listed).count() == 0
    assert urls.judge(pages, listed.limit(0)).where("verdict = 'allow'").count() == 7


def test_the_filter_passes_every_listed_key_and_few_others(spark):
    listed = spark.range(2000).select(F.concat(F.lit("host"), "id").alias("key"))
    blocks = 2000 * urls.BITS_A_KEY // urls.BLOCK_BITS
    words = F.lit(urls.bloom_words(listed, blocks))
    passed = lambda df: df.where(urls.may_hold(words, blocks, F.col("key"))).count()
    assert passed(listed) == 2000
    assert passed(spark.range(20_000).select(F.concat(F.lit("other"), "id").alias("key"))) < 200


def test_stays_in_the_jvm(spark):
    listed = spark.sql("SELECT 'com' host, '/' path, 'allow' verdict")
    plan = urls.judge(spark.sql("SELECT 1 page_id, 'http://a.com/' url"), listed)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
