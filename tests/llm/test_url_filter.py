import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import url_filter as u

URLS = [
    None, "", "no scheme", "http://EXAMPLE.com/en/7", "http://example.com/en/71", "https://a.b.example.com/en/1?x=1", "http://example.com/EN/7", "http://notexample.com/en/7",
    "http://example.net/de/8/9", "http://example.net/de/7", "http://x.example.net/de/80#f", "http://net/de/", "http://org/es", "http://w.org/es/x", "http://example.com", "http://example.com#/en/7",
    "http://m.casino-win.example.net/fr/", "http://casinos.example.net/", "http://a.example/casino/", "http://x/cgi-bin/y", "ftp://ads.doubleclick.net/", "ftp://doubleclick.netx/", "http://spam.a/robots.txt",
    "http://example.com/en/7" + "/x" * 5000, "://", "http://é.com/en/ü", "a://b://com/en/", "http://comp/en/", "http://example.com/en/7", "x\n://com/en/\nq",
]


def plain(url):
    """Brute force: every rule's meaning, written out."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for r in u.PREFIX_RULES:
        h, p = r.text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.text) > len(best.text)):
            best = r
    if best:
        return host, path, best.text, best.action
    s = url or ""
    m = re.match(r"[^/?#]*?://([^/?#]*)", s)
    labels = re.split(r"[^0-9a-z]+", m[1].lower()) if m else []
    low = s.lower()
    if low.endswith("/robots.txt"):
        return host, path, None, "allow"
    bad = any(r.text in labels for r in u.PATTERN_RULES if r.kind == "host_word") or "/wp-login." in low or "/cgi-bin/" in low or (m and re.search(r"(^|\.)doubleclick\.net(?![0-9a-z_.%-])", m[1].lower() + "/"))
    return host, path, None, "block" if bad else "allow"


def test_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("token", F.lit("x"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.filter_urls(df).collect()}
    assert got == {i: plain(x) for i, x in enumerate(URLS)}


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://com/en/"), (1, "http://com/en/"), (None, None)], "page_id long, url string")
    assert sorted((str(r.page_id), r.verdict) for r in u.filter_urls(df).collect()) == [("1", "block"), ("1", "block"), ("None", "allow")]
    assert u.filter_urls(df.limit(0)).collect() == []


def test_rules_are_filed_under_their_rarest_token(spark):
    index, _ = u.rule_index(spark, [u.UrlRule("example.com/en/7")], [], {"example": 90, "com": 50, "en": 70})
    assert {r.token for r in index.collect()} == {"", "com"}
    assert u.compile_rule(u.UrlRule("net/de/"))[1] == ["net", "de"]
    assert u.compile_rule(u.UrlRule("a*b^c", "block", "glob"))[1] == []
    assert u.compile_rule(u.UrlRule("||x.net^", "block", "glob"))[1] == ["x", "net"]
    for bad in (u.UrlRule("a", "maybe"), u.UrlRule("a b", "block", "host_word"), u.UrlRule("a", "block", "odd")):
        with pytest.raises(ValueError):
            u.compile_rule(bad)


def test_ten_thousand_rules_from_a_file(spark, tmp_path):
    """One of them under no token; against a loop over the rules for each of 300 URLs."""
    import random

    r = random.Random(5)
    lines = [f"prefix:h{k}.com/p{k % 7}" for k in range(4000)] + [f"@@prefix:h{k}.com/p{k % 7}/ok" for k in range(0, 4000, 3)] + [f"word:bad{k}" for k in range(3000)]
    lines += [f"||t{k}.net^" for k in range(1500)] + [f"/path{k}/*.gif|" for k in range(500)] + ["z*q^x", "! a remark", "", "@@||t7.net^good"]
    (tmp_path / "rules.txt").write_text("\n".join(lines))
    rules = u.read_rules(spark, f"file://{tmp_path}/rules.txt")
    assert len(rules) > 10_000 and u.UrlRule("h3.com/p3/ok", "allow") in rules and u.UrlRule("bad5", "block", "host_word") in rules
    prefixes, patterns = [x for x in rules if x.kind == "prefix"], [x for x in rules if x.kind != "prefix"]
    urls = [f"http://{r.choice(['', 'www.', 'bad%d.' % r.randrange(4000)])}{r.choice(['h%d.com' % r.randrange(4500), 't%d.net' % r.randrange(1800), 't7.net'])}/{r.choice(['p%d' % r.randrange(7), 'p%d/ok' % r.randrange(7), 'path%d/a.gif' % r.randrange(600), 'z1q/x', 'good'])}" for _ in range(300)]
    got = {x.page_id: x for x in u.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), prefixes, patterns).collect()}
    made = [(x, re.compile(u.compile_rule(x)[0])) for x in patterns]
    for i, url in enumerate(urls):
        host, path = re.match(r"http://([^/]*)(.*)", url).groups()
        fits = [x for x in prefixes if (host == x.text.split("/")[0] or host.endswith("." + x.text.split("/")[0])) and path.startswith("/" + x.text.split("/", 1)[1])]
        hits = [x for x, p in made if p.search(url)]
        want = max(fits, key=lambda x: len(x.text)).action if fits else "allow" if any(x.action == "allow" for x in hits) else "block" if hits else "allow"
        assert got[i].verdict == want, url
    assert {x.verdict for x in got.values()} == {"allow", "block"} and any(x.pattern == "z*q^x" for x in got.values())
