import os
import random
import time

from tonewright.llm import urlfilter
from tonewright.llm.queries import URL_RULES


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        for k, c in enumerate(rest):
            if c in "/?#":
                host, rest = rest[:k], rest[k:]
                break
        else:
            host, rest = rest, ""
        path = rest.split("#")[0].split("?")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(-len(h + p), i, h + p, a) for i, (a, h, p) in enumerate(rules) if ("." + host).endswith("." + h) and host and path.startswith(p)]
    return (host, path, *(min(fit)[2:] if fit else (None, "allow")))


URLS = [None, "", "no scheme", "http://", "://COM/en/", "x://com?en/", "HTTPS://A.B.Com/en/7?x#y", "http://example.com/en/7", "http://notexample.com/en/77",
        "http://example.com#/en/7", "a://b://example.org/es/", "http://example.net/de/8", "http://www.example.net/de/9", "http://x,example.com/en/7", "http://com./en/",
        "http://u@h.com:80/en/\nq", "http://.com/en/1", "http://ÄX.org/es/É", "http://example.com/en/7"]


def check(frame, rules, got):
    want = [(r.page_id, *brute(r.url, rules)) for r in frame.collect()]
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()))) == sorted(map(str, want))


def test_odd_urls(spark):
    frame = spark.createDataFrame([(i if i != 3 else None, u) for i, u in enumerate(URLS)] + [(5, URLS[5])], "page_id long, url string").selectExpr("*", "1 as key", "2 as host", "3 as rule")
    check(frame, URL_RULES, urlfilter.judge(frame, URL_RULES))
    check(frame, [], urlfilter.judge(frame, []))
    assert urlfilter.judge(frame.where("false"), URL_RULES).collect() == []


def test_many_paths_of_one_host():
    """20,000 nested and repeated path rules on one host and a few on others, against trying them all."""
    rng = random.Random(3)
    part = lambda: rng.choice(["a", "b", "é", "ab", "\U0001f600"])
    rules = [(rng.choice(["allow", "block"]), rng.choice(["example.com"] * 20 + ["com", "www.example.com"]), "/" + "/".join(part() for _ in range(rng.randint(0, 9)))) for _ in range(20_000)]
    urls = sorted((urlfilter.reversed_host(h), p) for h, p in ((rng.choice(["example.com", "www.example.com", "a.com", "x.org"]), "/" + "/".join(part() for _ in range(rng.randint(0, 12)))) for _ in range(300)))
    sweep = urlfilter.Sweep(urlfilter._ordered(rules))
    for key, path in urls:
        fit = [(-len(h + p), i) for i, (_, h, p) in enumerate(rules) if key.startswith(urlfilter.reversed_host(h)) and path.startswith(p)]
        assert sweep.fit(key, path) == (min(fit)[1] if fit else -1)
    host = urlfilter.Sweep(urlfilter._ordered(rules))
    began = time.process_time()
    for _ in range(10_000):
        host.fit("com.example.www.", "/a/b/ab/a/b")
    assert time.process_time() - began < 1


def test_a_long_url(spark):
    frame = spark.createDataFrame([(1, "http://example.com/en/7" + "x" * 10_000_000), (2, "http://" + "a." * 50_000 + "com/en/")], "page_id long, url string")
    check(frame, URL_RULES, urlfilter.judge(frame, URL_RULES))


def test_blocks_of_rules(spark, monkeypatch):
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string")
    monkeypatch.setattr(urlfilter, "MAX_RULES", 2)
    check(frame, URL_RULES, urlfilter.judge(frame, URL_RULES))


def test_pages(spark, small):
    frame = spark.read.parquet(os.path.join(small, "pages.parquet"))
    check(frame, URL_RULES, urlfilter.judge(frame, URL_RULES))


def test_the_contracts_rules(spark):
    """Each rule's word as the contract lists it, written out here, on a url that it alone decides."""
    want = {
        "http://a.com/en/1": ("com/en/", "block"),
        "http://www.example.com/en/70": ("example.com/en/7", "allow"),
        "http://a.net/de/8": ("net/de/", "allow"),
        "http://www.example.net/de/9": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"),
        "http://a.org/es/": ("org/es/", "block"),
    }
    frame = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(frame, URL_RULES).collect()}
    assert [got[k] for k in range(len(want))] == list(want.values())
