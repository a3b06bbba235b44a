"""URL filters against a rule-by-rule judge."""

import random

import pytest
from pyspark.sql import functions as F

from reviewloom.llm import queries, url_filters


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    stop = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
    return host, path[:stop]


def brute(url, rules):
    host, path = split(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2] if best else None, best[3] if best else "allow")


def judged(spark, urls, rules, **more):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = url_filters.judge_urls(df, url_filters.rule_table(spark, rules), **more)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}


def test_edge_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://NET", "x://net/", "x://A.net?q=/", "x://a.net#/en/", "x://www.Example.NET/en/1?a#b", "x://notexample.com/de/", "x://example.com/de/x", "x://b.org/fr/", "x://network/", "x://é.net/\n/a", "a://b://net/", "http://a.net/\U0010ffffx", "x://a.net\U0010ffff/", "x://example.com/de/\U0010ffff\U0010ffff", "x://c.\U0010ffff.org/fr/\uffff"]
    got = judged(spark, urls, queries.URL_RULES)
    assert got == {i: brute(u, queries.URL_RULES) for i, u in enumerate(urls)}


@pytest.mark.parametrize("parts", [1, 7])
def test_random_nested_rules(spark, parts):
    rng = random.Random(3)
    labels = ["a", "b", "ab", "net"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice(["x", "y/", "x/"]) for _ in range(rng.randint(0, 4)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(60))}.values())
    urls = [f"http://{host()}{path()}" for _ in range(400)] + ["http://a.net/x"] * 200
    assert judged(spark, urls, rules, parts=parts) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_no_rules_no_rows_and_repeats(spark):
    assert judged(spark, ["x://a/"], ())[0] == ("a", "/", None, "allow")
    assert judged(spark, [], queries.URL_RULES) == {}
    df = spark.createDataFrame([(None, "x://a.net/"), (None, "x://a.net/"), (1, None)], "page_id long, url string")
    out = url_filters.judge_urls(df, url_filters.rule_table(spark, queries.URL_RULES))
    assert out.where("page_id IS NULL AND verdict = 'block'").count() == 2
    assert out.count() == 3


def test_plan_is_native(spark):
    df = spark.range(5).select(F.col("id").alias("page_id"), F.lit("x://a.net/").alias("url"))
    plan = url_filters.judge_urls(df, url_filters.rule_table(spark, queries.URL_RULES))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))
