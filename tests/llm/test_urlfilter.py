import random
import re

from tallyforge.llm import urlfilter

PAGES = "page_id long, url string, html string, host string, path string, rule string, verdict string"


def brute(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), a, h + p) for a, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def judged(spark, urls, rules, **options):
    rows = spark.createDataFrame([(i, u, *["clash"] * 5) for i, u in enumerate(urls)], PAGES)
    got = urlfilter.judge_urls(rows, urlfilter.rules_frame(spark, rules), **options).collect()
    assert len(got) == len(urls)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}


def test_random_urls(spark):
    rng = random.Random(2)
    hosts = ["example", "net", "com", "org", "a", "EXAMPLE", "", "x.y"]
    urls = [None, "", "no scheme", "http://", "://net/", "http://net", "http://NET/", "http://a.example.net/en/x?q=http://org/fr/#y", "http://org/fr", "http://org/fr/", "http://xnet/", "a://b://net/", "http://ne\nt/x", "http://ünet.net/é/"]
    urls += [f"{rng.choice(['http', 'https', ''])}://{'.'.join(rng.choices(hosts, k=rng.randrange(1, 5)))}{rng.choice(['', '/', '/en/', '/de/x', '/fr/', '/en', '//en/', '?a', '#b', '/en/?c'])}" for _ in range(400)]
    urls += ["http://example.net/en/1"] * 50
    rules = [*urlfilter.RULES, ("block", "example.net", "/en/1"), ("allow", "a.net", ""), ("block", "y", "/fr")]
    for options in ({}, {"broadcast_bytes": 0}):
        got = judged(spark, urls, rules, **options)
        for i, u in enumerate(urls):
            assert got[i] == brute(u, rules), u


def test_empty(spark):
    assert judged(spark, [], urlfilter.RULES) == {}
    assert judged(spark, ["http://net/"], []) == {0: ("net", "/", None, "allow")}
    assert judged(spark, ["http://net/"], [], default="block")[0][3] == "block"


def test_many_labels(spark):
    """A host of many labels, and a long path, meet the rules in time linear in their length."""
    import time

    long = "a." * 100_000
    rules = [*urlfilter.RULES, ("block", ".".join("b" * 40), "/"), ("block", "a.example.net", "/en/x")]
    urls = [f"http://{long}net/x", f"http://{long}example.net/en/" + "y" * 1_000_000, f"http://{long}example.net/en/x", "http://" + "c." * 50_000 + ".".join("b" * 40) + "/", "http://" + ".".join("b" * 39) + "/"]
    start = time.perf_counter()
    got = judged(spark, urls, rules)
    assert time.perf_counter() - start < 60
    assert [got[i][2] for i in range(5)] == ["net/", "example.net/en/", "a.example.net/en/x", ".".join("b" * 40) + "/", None]
