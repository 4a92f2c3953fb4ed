import random

from pyspark.sql import functions as F

from urlsieve.functions.text import entropy, refang, strip, tokens
from urlsieve.operators.brand import osa


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_text(spark):
    assert one(spark, "　\x1c a b\x85", strip) == "a b"
    assert one(spark, " HXXPS[:]//a(dot)b[.]c{.}d[/]e[@] ", refang) == "httpS://a.b.c.d/e@"
    assert one(spark, "Ab-c9__é", tokens) == ["ab", "c9"]
    assert one(spark, "", entropy) == 0.0 and abs(one(spark, "aab\U0001f600", entropy) - 1.5) < 1e-9


def brute(a, b):
    if abs(len(a) - len(b)) > 3:
        return 4
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_osa(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(7)))
    pairs = [(word(), word()) for _ in range(300)] + [("ca", "abc"), ("", ""), ("", "ab"), ("ab", "")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", osa(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(x.d == brute(x.a, x.b) for x in got)


def test_safe_cells(spark):
    from urlsieve.sources.sinks import csv_safe, safe_text

    assert one(spark, "a\x07b​c\U000e0001", safe_text) == "a\\x07b\\u200bc\\ue0001"
    assert one(spark, "=1", csv_safe) == "'=1" and one(spark, "\t=1", csv_safe) == "\\x09=1"


def test_legacy_addresses(spark):
    from urlsieve.functions.urls import ipv4_text, ipv4_value

    cases = {"1": "0.0.0.1", "010.0.0.1": "8.0.0.1", "08.0.0.1": None, "999.1.1.1": None, "4294967296": None, "3232235777": "192.168.1.1", "0x7f.1": "127.0.0.1", "1.2.3.4.5": None, "a.b": None, "99999999999999999999": None}
    df = spark.createDataFrame([(h,) for h in cases], "h string").withColumn("v", ipv4_value(F.col("h")))
    got = {r.h: r.t for r in df.select("h", F.when(F.col("v").isNotNull(), ipv4_text(F.col("v"))).alias("t")).collect()}
    assert got == cases


def test_files(spark, tmp_path):
    from urlsieve.sources.files import read_blocklist, read_domains, read_urls

    (tmp_path / "u").write_bytes("http://a/\n# c\n\n b\x0bc http://a/\r\nd".encode())
    assert [r.url for r in read_urls(spark, str(tmp_path / "u")).orderBy("ord").collect()] == ["http://a/", "b", "c", "d"]
    (tmp_path / "d").write_text("1,Example.com\nhttps://x.org/y\n#\nz.net.\n")
    assert sorted(r.domain for r in read_domains(spark, str(tmp_path / "d")).collect()) == ["example.com", "x.org", "z.net"]
    (tmp_path / "b").write_text("hxxp://A[.]b/c/\nD.e.\n# x\n")
    urls, domains = read_blocklist(spark, str(tmp_path / "b"))
    assert [r.key for r in urls.collect()] == ["a.b/c"] and [r.domain for r in domains.collect()] == ["d.e"]


def test_stream(spark, tmp_path):
    from urlsieve.streaming.scan import read_stream, scan_stream, write_stream

    spark.createDataFrame([("http://evil.com",)], "url string").write.parquet(str(tmp_path / "in"))
    q = write_stream(scan_stream(read_stream(spark, str(tmp_path / "in"), "url string")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().score == 10


def test_provider(spark):
    from urlsieve.sources.providers import resolve, run

    assert resolve("[::1]")["ips"] == ["::1"]
    assert resolve("x", lookup=lambda *a: [(0, 0, 0, 0, ("1.2.3.4", 0)), (0, 0, 0, 0, ("1.2.3.4", 1))])["ips"] == ["1.2.3.4"]
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "h string")
    rows = run(keys, "h", "dns_obs", lambda h: {"host": h, "ips": ["9.9.9.9"], "error": None}, 2).collect()
    assert [(r.host, r.ips) for r in rows] == [("a", ["9.9.9.9"])]


def test_lookups_end_in_rows():
    import socket
    import ssl
    import time
    import urllib.error

    from urlsieve.sources import providers as P

    def fails(e):
        def look(*a, **k):
            raise e

        return look

    assert P.resolve("x", lookup=fails(socket.gaierror(1, "no")))["error"] == "unknown-name" and P.resolve("x", lookup=lambda *a: [])["error"] == "no-address"
    assert P.resolve("x", timeout=0.05, lookup=lambda *a: time.sleep(0.3))["error"] == "late"
    public = lambda *a: [(0, 0, 0, 0, ("9.9.9.9", 0))]
    assert P.fetch("ftp://x/")["failure"] == "no-web-address" and P.fetch("http://[x/")["failure"] == "unreadable"
    assert P.fetch("http://x/", lookup=lambda *a: [(0, 0, 0, 0, ("10.0.0.1", 0))])["failure"] == "not-public"
    assert P.fetch("http://x/", lookup=public, dial=fails(ConnectionRefusedError()))["failure"] == "refused"

    peers = []

    def dialled(answer, bad=False):
        def dial(request, timeout, trusting):
            if bad and not trusting:
                raise ssl.SSLCertVerificationError("self-signed")
            ours, theirs = socket.socketpair()
            theirs.sendall(answer)
            peers.append(theirs)
            return ours

        return dial

    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: 5\r\n\r\nhello"
    row = P.fetch("https://x:8443/a?b", body_limit=4, lookup=public, dial=dialled(page, bad=True))
    assert (row["status"], row["body"], row["failure"]) == (200, b"hell", None) and "self-signed" in row["tls_error"]
    row = P.fetch("http://x/", lookup=public, dial=dialled(b"HTTP/1.1 302 Found\r\nLocation: /y\r\nContent-Length: 1\r\n\r\nz"))
    assert (row["status"], row["location"], row["body"]) == (302, "/y", b"")
    assert set(row) == {x.split()[0] for x in P._top_level(P.SCHEMAS["hop_obs"])} - {"obs_id", "obs_ts"}

    missing = urllib.error.HTTPError("u", 404, "", {}, None)
    assert P.registration("x.test", ask=lambda *a, **k: {"events": [{"eventAction": "registration", "eventDate": "2020"}]})["events"] == [{"eventAction": "registration", "eventDate": "2020"}]
    assert P.registration("x.test", ask=fails(missing))["error"] == "status"
    assert P.safe_browsing("u", "k", ask=lambda *a: {"matches": [{"threatType": "B"}, {}]})["threat_types"] == ["B", "UNKNOWN"]
    assert P.engines_report("u", "k", ask=fails(missing)) == {"url": "u", "has_report": False, "malicious": None, "suspicious": None, "error": None}
    assert P.engines_report("u", "k", ask=lambda *a, **k: {"data": {}})["error"] == "unreadable"
    assert P.engines_report("u", "k", ask=lambda *a, **k: {"data": {"attributes": {"last_analysis_stats": {"malicious": 2}}}})["malicious"] == 2
    assert P.report_id("http://a/?>") == "aHR0cDovL2EvPz4"
