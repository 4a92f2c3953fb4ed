"""Each rule of the catalogue has a hit and a near miss among the cases whose SQL the driver compares."""

from urlsieve.config import get_default_config
from urlsieve.operators.brand import ARMS
from urlsieve.operators.rules import catalogue
from urlsieve.plans.analyze import analyze
from urlsieve.plans.rule_queries import CASES


def test_every_rule_is_met_and_missed(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "i int, url string")
    rows = analyze(df, "url", keep=["i"]).collect()
    met = {x.rule_id for r in rows for x in r.indicators}
    rules = {r.rule_id for group in catalogue(get_default_config()).values() for r in group} | set(ARMS) | {"BR-combo", "T1", "T2", "T4", "AL"}
    # need characters beyond ASCII, or a failure
    assert rules - met == {"R15", "R17", "BR-5", "I2"}
    assert len(rows) == len(CASES) and all(any(x not in {i.rule_id for i in r.indicators} for r in rows) for x in rules)


def test_odd_input(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), (" \t", 3), ("http://" + "a" * 100_000 + ".test/" + "b" * 100_000, 4), ("https://ü.test/%zz?%=%&&=&next=http://[x", 5), ("https://a.test/", 6), ("https://a.test/", 6)], "url string, score int")
    rows = analyze(df, "url", keep=[]).collect()
    assert len(rows) == 7 and sorted(r.classification for r in rows)[:3] == ["INVALID / HIGH RISK"] * 3
    bad = next(r for r in rows if "%zz" in r.url)
    assert {"I2", "R15"} <= {i.rule_id for i in bad.indicators}
    assert analyze(df.limit(0), "url").count() == 0
