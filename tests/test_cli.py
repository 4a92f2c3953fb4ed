import csv
import json

import pytest

from urlsieve import cli
from urlsieve.config import Config, Options


def run(spark, capsys, *argv):
    status = cli.main(list(map(str, argv)), spark)
    said = capsys.readouterr()
    return status, said.out, said.err


def test_scan_reports(spark, capsys, tmp_path):
    urls, out, table = tmp_path / "urls.txt", tmp_path / "out.json", tmp_path / "out.csv"
    urls.write_text("# list\nhttps://example.com/\x0bhttps://paypal.evil.test/login\r\n\nhttps://example.com/\njavascript:x\n=1+1\n", encoding="utf-8")
    status, said, _ = run(spark, capsys, "-f", urls, "--json", out, "--csv", table, "--verbose")
    assert status == 1 and said.index("https://example.com/") < said.index("https://paypal.evil.test/login") < said.index("javascript:x")
    rows = json.loads(out.read_text())
    assert [r["url"] for r in rows] == ["https://example.com/", "https://paypal.evil.test/login", "javascript:x", "=1+1"]
    assert set(rows[0]) == {"url", "normalized_url", "hostname", "hostname_unicode", "registered_domain", "ip_address", "allowlisted", "score", "classification", "reasons", "indicators", "resolved_ips", "redirect_chain", "final_url"}
    assert rows[2]["score"] == 100 and rows[2]["normalized_url"] == ""
    raw = table.read_bytes()
    cells = list(csv.reader(raw.decode().splitlines()))
    assert raw.count(b"\r\n") == 5 and cells[0][:4] == ["url", "hostname", "registered_domain", "score"] and cells[4][0] == "'=1+1"
    assert out.read_text().startswith("[\n  {") and out.read_text().isascii()


@pytest.mark.parametrize("url,level,status", [("https://example.com/", "high", 0), ("javascript:x", "high", 1), ("javascript:x", "none", 0), ("http://paypal.test/", "medium", 1), ("http://paypal.test/", "high", 0)])
def test_exit_status(spark, capsys, url, level, status):
    assert run(spark, capsys, "-u", url, "--fail-on", level, "--quiet")[0] == status


def test_one_url_and_bad_sink(spark, capsys, tmp_path):
    status, said, err = run(spark, capsys, "-u", " https://example.com/ ", "--json", tmp_path / "no" / "x.json")
    assert status == 0 and "https://example.com/" in said and "can't write" in err
    status, said, _ = run(spark, capsys, "-u", "https://example.com/", "--json", "-")
    assert json.loads(said)[0]["url"] == "https://example.com/"


def test_part_files(spark, capsys, tmp_path):
    run(spark, capsys, "-u", "https://example.com/", "-u", "javascript:x", "--json", f"{tmp_path}/j/", "--csv", f"{tmp_path}/c/", "--quiet")
    assert {r.url for r in spark.read.json(f"{tmp_path}/j").collect()} == {"https://example.com/", "javascript:x"}
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 2


def test_blocklist_and_allowlist(spark, capsys, tmp_path):
    (tmp_path / "bad.txt").write_text("bad[.]test\nhxxp://good.test/x/\n#c\n")
    (tmp_path / "good.txt").write_text("1,shop.test\n")
    out = tmp_path / "o.json"
    run(spark, capsys, "-u", "https://a.bad.test/", "-u", "http://good.test/x", "-u", "https://good.test/y", "-u", "https://shop.test/", "--blocklist", tmp_path / "bad.txt", "--allowlist", tmp_path / "good.txt", "--json", out, "--quiet")
    rows = {r["url"]: r for r in json.loads(out.read_text())}
    hit = {u: [i["points"] for i in r["indicators"] if i["category"] == "intel"] for u, r in rows.items()}
    assert hit == {"https://a.bad.test/": [70], "http://good.test/x": [70], "https://good.test/y": [], "https://shop.test/": []}
    assert [r["allowlisted"] for r in rows.values()] == [False, False, False, True]


def test_evaluate(spark, capsys, tmp_path):
    (tmp_path / "good.txt").write_text("https://example.com/\nhttps://example.com/\nhttps://example.org/\n")
    (tmp_path / "bad.txt").write_text("javascript:x\nhttp://paypal.evil.test/login\n")
    status, said, _ = run(spark, capsys, "--evaluate", tmp_path / "good.txt", tmp_path / "bad.txt")
    assert status == 0 and "Best F1 at threshold 60" in said and len([x for x in said.splitlines() if x.strip()[:1].isdigit()]) >= 19


def test_usage(spark, capsys, tmp_path):
    assert json.loads(run(spark, capsys, "--dump-config")[1]) == Config().to_dict()
    assert run(spark, capsys, "-f", tmp_path / "none.txt")[0] == 2
    (tmp_path / "c.json").write_text('{"medium_threshold": 90}')
    assert run(spark, capsys, "-u", "x", "--config", tmp_path / "c.json")[0] == 2
    (tmp_path / "empty.txt").write_text("# nothing\n")
    assert run(spark, capsys, "-f", tmp_path / "empty.txt")[0] == 2
    with pytest.raises(SystemExit):
        cli.arguments(["-u", "x", "-f", "y"])


def test_options():
    of = lambda *a: cli.options_of(cli.arguments(list(a)))
    assert of("--full", "--gsb-key", "k") == Options(dns=True, redirects=True, content=True, rdap=True, gsb=True)
    assert of("--content", "--timeout", "2") == Options(redirects=True, content=True, timeout=2.0)
    assert of("--full", "--vt", "--offline") == Options()


def test_live_look_ups(spark):
    from urlsieve.plans.analyze import analyze
    from urlsieve.sources import live

    pages = {"https://a.test": (302, "/b"), "https://a.test/b": (301, "http://c.test/"), "http://c.test/": (200, None)}
    ask = {
        "dns_obs": lambda h: {"host": h, "ips": ["9.9.9.9"] if h != "gone.test" else [], "error": None if h != "gone.test" else "unknown-name"},
        "hop_obs": lambda u: {"url": u, "failure": None if u in pages else "refused", "status": pages.get(u, (None, None))[0], "location": pages.get(u, (None, None))[1], "content_type": "", "body": b""},
        "rdap_obs": lambda d: {"domain": d, "events": [{"eventAction": "registration", "eventDate": "2001-01-01"}], "error": None},
        "vt_obs": lambda u: {"url": u, "has_report": True, "malicious": 3 * (u == "http://c.test/"), "suspicious": 0, "error": None},
    }
    urls = spark.createDataFrame([(1, "a.test"), (2, "https://gone.test/"), (3, "mailto:x"), (4, None)], "id int, url string")
    options = Options(dns=True, redirects=True, rdap=True, vt=True)
    seen = live.observations(urls, "url", options, ask=ask)
    assert {r.host for r in seen["dns_obs"].collect()} == {"a.test", "gone.test", "c.test"}
    assert {r.url for r in seen["hop_obs"].collect()} == {"https://a.test", "http://a.test", "https://a.test/b", "http://c.test/", "https://gone.test/"}
    got = {r.id: r for r in analyze(urls, "url", options=options, keep=["id"], observations=seen).collect()}
    assert got[1].redirect_chain == ["https://a.test", "https://a.test/b", "http://c.test/"] and got[1].final_url == "http://c.test/" and got[1].resolved_ips == ["9.9.9.9"]
    assert {"VT-3", "N19"} <= {i.rule_id for i in got[1].indicators} and "N01" in [i.rule_id for i in got[2].indicators] and got[3].resolved_ips == []
    assert live.asking(options, {"gsb": None, "vt": "k"}).keys() == {"dns_obs", "hop_obs", "rdap_obs", "vt_obs"}
