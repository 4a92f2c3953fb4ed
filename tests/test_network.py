"""The network stage as a whole, and each of its rules by a hit and a near miss, over recorded observations."""

import datetime

import pytest
from pyspark.sql import functions as F

from urlsieve.config import Config, Options
from urlsieve.operators import network
from urlsieve.plans.analyze import analyze
from urlsieve.sources.observations import SCHEMAS


def now():
    return F.lit("2024-06-30 00:00:00").cast("timestamp")

DAY = datetime.timedelta(days=1)
END = datetime.datetime(2024, 6, 30)


def scan(spark, urls, options, dns=(), hops=(), rdap=(), gsb=(), vt=()):
    """{url: {rule: points}} with the given observations."""
    tables = {}
    for name, rows, width in (("dns_obs", dns, 3), ("hop_obs", hops, 8), ("rdap_obs", rdap, 3), ("gsb_obs", gsb, 3), ("vt_obs", vt, 5)):
        rows = [(*r, *[None] * (width - len(r)), i, END) for i, r in enumerate(rows)]
        tables[name] = spark.createDataFrame(rows, SCHEMAS[name])
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = analyze(df, "url", options=options, observations=tables, now=now()).collect()
    assert len(rows) == len(urls)
    return {r.url: r for r in rows}, {r.url: {i.rule_id: i.points for i in r.indicators} for r in rows}


def page(url, body, status=200, kind="text/html", **more):
    return (url, status, None, kind, body if isinstance(body, bytes) else body.encode(), more.get("tls"), more.get("since"), None)


def test_without_observations_nothing_is_scored(spark):
    _, plain = scan(spark, ["https://a.test/"], Options())
    _, told = scan(spark, ["https://a.test/"], Options(dns=True, redirects=True, content=True))
    assert told["https://a.test/"].get("N00") == 0 and sum(told["https://a.test/"].values()) == sum(plain["https://a.test/"].values())


def test_dns(spark):
    many = [f"9.9.9.{i}" for i in range(9)]
    dns = [("gone.test", [], "boom"), ("empty.test", None), ("inner.test", ["9.9.9.9", "10.0.0.1"]), ("many.test", [*many, *many]), ("eight.test", many[:8])]
    rows, got = scan(spark, [f"https://{d[0]}/" for d in dns] + ["https://10.0.0.1/", "mailto:x", None], Options(dns=True), dns)
    ids = {u: {r: p for r, p in x.items() if r[0] == "N"} for u, x in got.items()}
    assert ids == {"https://gone.test/": {"N01": 8}, "https://empty.test/": {"N01": 8}, "https://inner.test/": {"N02": 10}, "https://many.test/": {"N03": 5}, "https://eight.test/": {}, "https://10.0.0.1/": {}, "mailto:x": {}, "": {}}
    assert rows["https://many.test/"].resolved_ips == sorted(many) and rows["https://10.0.0.1/"].resolved_ips == ["10.0.0.1"]


def test_walks_and_landings(spark):
    dns = [(f"{h}.test", ["9.9.9.9"]) for h in "abcdes"] + [("p.test", ["10.0.0.1"]), ("u.test", [], "boom"), ("bit.ly", ["9.9.9.9"])]
    go = lambda u, to, **m: (u, 302, to, "", b"", m.get("tls"), m.get("since"), None)
    hops = [
        go("https://a.test/", "https://u.test/"),
        go("https://b.test/", "ftp://c.test/"),
        go("https://c.test/", "https://p.test/"),
        go("https://d.test/", "https://e.test/1", tls="expired", since=END - 8 * DAY),
        go("https://e.test/1", "https://e.test/2", tls="expired"),
        go("https://e.test/2", "https://paypal.evil.test/login"),
        go("https://bit.ly/x", "https://s.test/"),
        page("https://s.test/", "", since=END - 7 * DAY),
        ("https://x.test/", None, None, None, None, None, None, "late"),
    ]
    _, got = scan(spark, [f"https://{h}.test/" for h in "abcd"] + ["https://bit.ly/x", "https://x.test/"], Options(redirects=True), dns + [("paypal.evil.test", ["9.9.9.9"]), ("x.test", ["9.9.9.9"])], hops)
    ids = {u: {r: p for r, p in x.items() if r[0] == "N"} for u, x in got.items()}
    assert ids["https://a.test/"] == {"N11": 8, "N19": 10} and ids["https://b.test/"] == {"N10": 15, "N19": 10} and ids["https://c.test/"] == {"N12": 20, "N19": 10}
    walked = ids["https://d.test/"]
    assert walked["N14"] == 15 and walked["N18"] == 12 and walked["N19"] == 10 and 15 <= walked["N20"] <= 30 and "N15" not in walked and walked["N13"] == 0
    assert ids["https://bit.ly/x"] == {"N15": 8} and ids["https://x.test/"] == {"N13": 0}


def test_page_rules(spark):
    form = '<form action="{}"><input type="password"></form>'
    bodies = {
        "away": form.format("https://other.test/in"),
        "asks": "<form action='https://other.test/in'><input></form>",
        "plain": form.format("http://plain.test/in"),
        "own": form.format("/in"),
        "titled": "<title>PayPal: sign in</title>",
        "fresh": '<meta http-equiv="refresh" content="0;url=https://next.test/">',
        "broken": "<form action='http://[x'></form>" + form.format("https://other.test/in"),
        "late": form.format("https://other.test/in") + "<form action='http://[x'></form>",
        "none": "",
        "wide": "<title>PayPal</title>".encode("utf-16"),
    }
    dns = [(f"{n}.test", ["9.9.9.9"]) for n in [*bodies, "text", "fail"]] + [("wikipedia.org", ["9.9.9.9"])]
    hops = [page(f"https://{n}.test/", b, kind="text/html; charset=utf-16" if n == "wide" else "text/html") for n, b in bodies.items()]
    hops += [page("https://text.test/", bodies["away"], kind="text/plain"), page("https://fail.test/", bodies["away"], status=404), page("https://wikipedia.org/", bodies["away"])]
    urls = [h[0] for h in hops]
    rdap = [("late.test", [("registration", "2024-06-20")]), ("broken.test", [("registration", "2024-06-20")])]
    _, got = scan(spark, urls, Options(content=True, rdap=True), dns, hops, rdap)
    ids = {u[8:-1].removesuffix(".test"): {r: p for r, p in x.items() if r[0] == "C" or r in ("N40", "N30")} for u, x in got.items()}
    assert ids == {
        "away": {"C1": 8, "C2": 30},
        "asks": {"C2": 20},
        "plain": {"C1": 8, "C3": 12},
        "own": {"C1": 8},
        "titled": {"C4": 25},
        "fresh": {"C5": 0},
        "broken": {"N40": 0},
        "late": {"C1": 8, "C2": 30, "N30": 25},
        "none": {},
        "wide": {"C4": 25},
        "text": {},
        "fail": {},
        "wikipedia.org": {},
    }


@pytest.mark.parametrize("days,rule", [(0, "N30"), (29, "N30"), (30, "N31"), (89, "N31"), (90, "N32"), (179, "N32"), (180, None)])
def test_ages(spark, days, rule):
    df = spark.createDataFrame([("a.test", days, None)], "d string, a int, e string").select(network.age_rule(F.col("d"), F.col("a"), F.col("e"))["rule_id"].alias("r"))
    assert df.first().r == rule


def test_ages_of_fitting_domains(spark):
    rdap = [("new.test", [("registration", "2024-06-29T00:00:01Z")]), ("odd.test", [("registration", "who knows")]), ("wikipedia.org", [("registration", "2024-06-29")])]
    urls = ["https://www.new.test/", "https://odd.test/", "https://unseen.test/", "https://wikipedia.org/", "https://bit.ly/", "https://9.9.9.9/", "https://localhost/"]
    _, got = scan(spark, urls, Options(rdap=True), rdap=rdap)
    ids = {u: {r: p for r, p in x.items() if r[0] == "N"} for u, x in got.items()}
    assert ids == {urls[0]: {"N30": 25}, urls[1]: {"N33": 0}, urls[2]: {"N33": 0}, urls[3]: {}, urls[4]: {}, urls[5]: {}, urls[6]: {}}


def test_threat_reports(spark):
    urls = [f"https://{n}.test/" for n in ("listed", "clean", "failed", "three", "one", "three-suspect", "two-suspect", "unknown", "error", "unseen")]
    u = lambda n: f"https://{n}.test/"
    gsb = [(u("listed"), ["MALWARE", "A"]), (u("clean"), []), (u("failed"), None, "late")]
    vt = [(u("three"), True, 3, 0), (u("one"), True, 2, 5), (u("three-suspect"), True, 0, 3), (u("two-suspect"), True, 0, 2), (u("unknown"), False), (u("error"), None, None, None, "late")]
    _, got = scan(spark, urls, Options(gsb=True, vt=True), gsb=gsb, vt=vt)
    ids = {x[8:].removesuffix(".test/"): {r: p for r, p in i.items() if r[:3] in ("GSB", "VT-") and r != "VT-0"} for x, i in got.items()}
    assert ids == {"listed": {"GSB": 60}, "clean": {}, "failed": {"GSB-E": 0}, "three": {"VT-3": 55}, "one": {"VT-1": 30}, "three-suspect": {"VT-S": 15}, "two-suspect": {}, "unknown": {}, "error": {"VT-E": 0}, "unseen": {}}
    assert got[u("unknown")]["VT-0"] == 0


def test_hot_host_and_long_allowlist(spark, monkeypatch):
    from urlsieve.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    urls = [f"https://hot.test/{i}" for i in range(40)] + [f"https://shop{i}.test/" for i in range(20)] + [None]
    trusted = Config().trusting({f"shop{i}.test" for i in range(2000)})
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    obs = {"dns_obs": spark.createDataFrame([("hot.test", [], "boom", 1, END)], SCHEMAS["dns_obs"])}
    rows = analyze(df, "url", config=trusted, options=Options(dns=True), observations=obs, now=now()).collect()
    assert len(rows) == 61 and sum(r.allowlisted for r in rows) == 20 and sum(any(i.rule_id == "N01" for i in r.indicators) for r in rows) == 40


def test_a_row_that_cannot_be_analysed_stays_one_row(monkeypatch):
    import pandas as pd

    from urlsieve.functions import hosts

    def crash(netloc):
        raise RuntimeError

    monkeypatch.setattr(hosts, "host_facts", crash)
    assert hosts.netloc_facts.rows(pd.Series(["ü.test", None]))["crashed"].tolist() == [True, None]
    monkeypatch.setattr(hosts, "fold", crash)
    assert hosts.text_facts.rows(pd.Series([["/", "a", "", ""], None]))["failed"].tolist() == [True, None]
    assert hosts.guarded(crash, 7)(1) == 7
