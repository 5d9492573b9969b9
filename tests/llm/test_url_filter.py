import re
from collections import Counter

from flowloom.llm.queries import URL_RULES
from flowloom.llm.url_filter import filter_urls, judge_urls

URLS = [None, "", "no scheme", "http://", "https://WWW.Example.COM/en/1?x#y", "http://www.example.com/en", "http://a.www.example.com/en/",
        "http://example.com", "http://example.com?q=/en/", "http://notexample.com/en/", "ftp://x.net/es/a", "http://net/fr/", "http://x.net#/fr/",
        "http://xnet/es/", "http://a..com/", "a://b://c.com/", "http://example.com:80/en/", "x\n://www.example.com/en/b\nc", "http://ÄÖ.com/en/é"]


def brute(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fit = [(len(h) + len(p), len(h), v == "block", h, p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] + best[4] if best else None, best[5] if best else default


def test_against_brute_force(spark):
    rules = [*URL_RULES, ("com", "", "block"), ("com", "", "allow"), ("x.net", "/es/a", "allow")]
    for own in (URL_RULES, rules):
        table = spark.createDataFrame(own, "host string, path string, verdict string")
        pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS * 2)] + [(None, URLS[4], "r")], "page_id long, url string, rule string")
        got = Counter((r.row.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, table).collect())
        assert got == Counter((i, *brute(u, own)) for i, u in [*enumerate(URLS * 2), (None, URLS[4])])


def test_no_rules_no_pages_null_rules(spark):
    pages = spark.createDataFrame([(u,) for u in URLS], "url string")
    none = spark.createDataFrame([(None, "/", "allow"), ("com", None, "block")], "host string, path string, verdict string")
    assert {r.verdict for r in judge_urls(pages, none, default="block").collect()} == {"block"}
    assert judge_urls(pages.filter("false"), none).count() == 0


def test_join_on_the_short_prefix_only(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    plan = filter_urls(spark.createDataFrame([(1, URLS[4])], "page_id long, url string"), rules)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join Inner" in x and "short" in x]
    assert len(joins) == 1 and "digest" not in joins[0] and "r_host" not in joins[0]
