"""Goldens: expected (rule, points) of URLs, worked out by hand from the rule catalogue."""

import pytest
from pyspark.sql import functions as F

from urlsieve.config import Config, Options
from urlsieve.plans.analyze import analyze

CASES = [
    ("http://paypal.com@evil.com/", 60, {("R01", 10), ("R10", 25), ("R11", 25)}),
    ("paypal.com.evil.xyz", 55, {("R00", 0), ("R24", 3), ("R43", 12), ("BR-1", 40)}),
    ("http://good.com\\@evil.com", 70, {("R01", 10), ("R10", 25), ("R11", 25), ("R19", 10)}),
    ("3232235777", 45, {("R00", 0), ("R12", 25), ("R13", 20)}),
    ("http://0x7f.1/", 55, {("R01", 10), ("R12", 25), ("R13", 20)}),
    ("hxxp://evil[.]com", 10, {("I1", 0), ("R01", 10)}),
    ("https://a.b.paypal.com/login/verify/account", 3, {("R24", 3), ("R31", 7), ("AL", 0)}),
    ("javascript:alert(1)", 100, {("T1", 100)}),
    ("mailto:a@b.c", 0, {("T2", 0)}),
    ("mailto://h", 25, {("R02", 15), ("R21", 10)}),
    ("http://[bad", 100, {("T3", 100)}),
    ("http:///x", 100, {("T4", 100)}),
    (None, 100, {("T4", 100)}),
    ("http://[::1]:8080/", 43, {("R01", 10), ("R12", 25), ("R14", 0), ("R61", 8)}),
    ("http://paypa1.com/", 50, {("R01", 10), ("BR-6", 40)}),
    ("http://micorsoft.com", 40, {("R01", 10), ("BR-7", 30)}),
    ("https://github.io/", 35, {("BR-3", 35)}),
    ("http://t.co/x", 10, {("R01", 10), ("R40", 20), ("AL", 0)}),
    ("http://x.com/?url=http://[bad", 4, {("R01", 10), ("I2", 0), ("AL", 0)}),
    ("http://ex.com:99999/", 20, {("R01", 10), ("R60", 10)}),
    ("http://ex.com:8443/a//b", 26, {("R01", 10), ("R52", 8), ("R61", 8)}),
    ("http://a%41b.com/", 35, {("R01", 10), ("R20", 10), ("R50", 15)}),
    ("https://ex.com/a.pdf.exe", 25, {("R80", 15), ("R82", 15)}),
    ("https://ex.com/1/2/3/4/5?a=1&b=2;c=3&d=4&e=5&f=6", 10, {("R71", 5), ("R73", 5)}),
]


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame([(i, u, "x") for i, (u, _, _) in enumerate(CASES)], "ord int, address string, score string")
    # extra columns with clashing names don't matter
    return {r.ord: r for r in analyze(df, "address", keep=["ord"]).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_golden(results, i):
    url, score, rules = CASES[i]
    r = results[i]
    assert (r.score, {(x.rule_id, x.points) for x in r.indicators}) == (score, rules), url


def test_points_in_order(results):
    for r in results.values():
        assert [x.points for x in r.indicators] == sorted((x.points for x in r.indicators), reverse=True)


def test_international(spark):
    df = spark.createDataFrame([("http://pаypal.com/login",), ("http://xn--pypal-4ve.com/",)], "url string")
    a, b = analyze(df).collect()
    assert a.hostname == b.hostname == "xn--pypal-4ve.com"
    assert {("BR-5", 55), ("R17", 30), ("R15", 8)} <= {(x.rule_id, x.points) for x in a.indicators} & {(x.rule_id, x.points) for x in b.indicators}


def test_config():
    c = Config.from_dict({"category_caps": {"brand": 5}, "shorteners": ["A.B"], "nonsense": 1})
    assert c.category_caps["brand"] == 5 and c.category_caps["dns"] == 20 and c.shorteners == {"a.b"}
    with pytest.raises(ValueError):
        Config(medium_threshold=60, high_threshold=60)
    assert Config.from_dict(Config().to_dict()).to_dict() == Config().to_dict()


def test_walk(spark):
    from urlsieve.operators.network import dns_table, walk

    hop = "url string, status int, location string, content_type string, body binary, tls_error string, cert_not_before timestamp, failure string"
    rows = [("http://a.test/", 301, "/b"), ("http://a.test/b", 302, "http://c.test/"), ("http://c.test/", 200, None), ("http://l.test/", 301, "http://l.test/"), ("http://m.test/", 301, "http://[x")]
    rows += [(f"http://n.test/{i}", 301, f"/{i + 1}") for i in range(8)]
    hops = spark.createDataFrame([(u, s, x, "", None, None, None, None) for u, s, x in rows], hop)
    dns = dns_table({"dns_obs": spark.createDataFrame([(f"{h}.test", ["8.8.8.8"] if h != "p" else ["10.0.0.1"], None) for h in "aclmnp"], "host string, ips array<string>, error string")}, spark)
    starts = ["http://a.test/", "http://l.test/", "http://m.test/", "http://n.test/0", "http://p.test/", "http://q.test/", "ftp://a.test/"]
    got = {r.start: r for r in walk(spark.createDataFrame([(s,) for s in starts], "start string"), hops, dns, Options(redirects=True), F.lit("2024-01-01").cast("timestamp")).collect()}
    ids = {s: [x.rule_id for x in r.found] for s, r in got.items()}
    assert got["http://a.test/"].chain == ["http://a.test/", "http://a.test/b", "http://c.test/"] and got["http://a.test/"].status == 200
    assert ids["http://l.test/"] == ["N17"] and ids["http://n.test/0"] == ["N16"] and len(got["http://n.test/0"].chain) == 6
    assert got["http://m.test/"].aborted and ids["http://p.test/"] == ["N12"] and ids["http://q.test/"] == [] and ids["ftp://a.test/"] == ["N10"]


def test_page():
    from urlsieve.functions.hosts import page_facts

    title, _, passwords, refresh, forms, failed = page_facts(b'<title>Pay<b></b>Pal</title><form action="//o.test/x"><input type=password></form><input type=PASSWORD><meta http-equiv=Refresh content="0; url=\'/y\'"><script>"<form>"</script>', "text/html", "https://a.test/")
    assert (title, passwords, refresh, failed) == ("PayPal", 2, "/y", False)
    assert forms == [{"action": "//o.test/x", "password": 1, "target_scheme": "https", "target_domain": "o.test"}]


def test_evaluate_edge_cases(spark):
    from urlsieve.operators.evaluate import metrics

    none = metrics(spark.createDataFrame([], "score int, bad boolean"), [5]).collect()[0]
    assert (none.tp, none.fp, none.precision, none.f1) == (0, 0, 0.0, 0.0)
    r = metrics(spark.createDataFrame([(50, True), (None, True), (10, False)], "score int, bad boolean"), [50]).collect()[0]
    assert (r.tp, r.fp, r.tn, r.fn, r.precision, r.recall) == (1, 0, 1, 1, 1.0, 0.5)


def test_domain_ages(spark):
    from urlsieve.operators.network import domain_ages

    e = "domain string, events array<struct<eventAction: string, eventDate: string>>, error string"
    reg = lambda d: ("registration", d)
    rows = [("a", [reg("bad"), reg("2023-12-31T00:00:01Z")], None), ("b", [reg("2024-06-01")], None), ("c", [("expiration", "2020-01-01"), (None, None)], None), ("d", None, None), ("e", [], "boom")]
    got = {r.domain: (r.age, r.error is not None) for r in domain_ages(spark.createDataFrame(rows, e), F.lit("2024-01-31").cast("timestamp")).collect()}
    assert got == {"a": (30, False), "b": (0, False), "c": (None, True), "d": (None, True), "e": (None, True)}
