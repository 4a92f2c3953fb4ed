"""Queries for the URL operators, each over whole tables, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import refdata as R
from ..config import Options, get_default_config
from ..functions.text import entropy, refang, strip, tokens
from ..functions.urls import PRIVATE_V4, PUBLIC_V4, canonical_key, domain_parts, normalized, parse, special_scheme, split_url
from ..operators import network
from ..operators.blocklist import match_hosts
from ..operators.evaluate import SWEEP, metrics
from ..operators.evaluate import best as best_row
from ..operators.rules import catalogue, group_column
from ..operators.score import classify, compute_score
from ..operators.skew import lookup_join
from ..runtime import cut, table
from ..sources.files import first_occurrences, split_blocklist
from ..sources.observations import latest
from ..sources.sinks import csv_safe
from .analyze import analyze

#: The time that ages are measured against in queries, so that they give the same on every day.
NOW = "2024-01-08 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def text_refang(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "results").select("result_id", refang(F.col("url")).alias("cleaned"), strip(F.col("url")).alias("given"))
    return s.select("result_id", "cleaned", (F.col("cleaned") != F.col("given")).alias("defanged"))


def text_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "results").select("result_id", F.array_join(tokens(F.col("url")), " ").alias("tokens"))


def text_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "hostinfo").select("host_id", F.round(entropy(F.col("host")), 6).alias("entropy"))


def url_schemes(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "results").select("result_id", refang(F.col("url")).alias("c"))
    norm, explicit = normalized(F.col("c"))
    return s.select("result_id", special_scheme(F.col("c")).alias("special"), norm.alias("normalized"), explicit.alias("explicit"))


def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "results").select("result_id", refang(F.col("url")).alias("c"))
    s = s.select("result_id", normalized(F.col("c"))[0].alias("n"))
    return split_url(s, "n", ["result_id"])


def host_domains(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "hostinfo").select("host_id", domain_parts(F.col("host")).alias("d"))
    return s.select("host_id", "d.subdomain", "d.sld", "d.suffix")


def hosts_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Every host column of the parse stage for results.url (Unicode hosts included)."""
    s = parse(table(spark, folder, "results").select("result_id", F.col("url").alias("__url_in")), "__url_in")
    return s.select("result_id", "valid", "host", "host_uni", "is_ip", "ip", "obfuscated_ip", "ip_private", "subdomain", "sld", "suffix", "registered_domain", "free_hosting", "port", "port_invalid", "username")


def rules_path(spark: SparkSession, folder: str) -> DataFrame:
    """R03 to R05 and R70 to R74 for every URL."""
    s = table(spark, folder, "results").select("result_id", refang(F.col("url")).alias("c"))
    s = s.select("result_id", normalized(F.col("c"))[0].alias("normalized"))
    s = split_url(s, "normalized", ["result_id", "normalized"])
    s = s.withColumns({"x_segments": F.size(F.filter(F.split("path", "/"), lambda x: x != "")), "x_params": F.size(F.filter(F.split("query", "[&;]"), lambda x: x != ""))})
    rules = catalogue(get_default_config())
    return s.select("result_id", F.explode(F.concat(group_column(rules["length"]), group_column(rules["path"]))).alias("r")).select("result_id", "r.rule_id", "r.category", "r.points")


def scan_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The whole offline scan of results.url."""
    out = analyze(table(spark, folder, "results").select("result_id", "url"), "url", keep=["result_id"])
    return out.select("result_id", "hostname", "registered_domain", "ip_address", "allowlisted", "score", "classification", F.array_join(F.transform("indicators", lambda i: i["rule_id"]), " ").alias("rules"))


def score_indicators(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "results")
    return s.select("result_id", compute_score(F.col("indicators"), F.col("allowlisted"), get_default_config()).alias("total"))


def class_counts(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "results").select(classify(F.col("score"), get_default_config()).alias("class"))
    return s.groupBy("class").agg(F.count(F.lit(1)).alias("rows"))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "results").select("score", F.coalesce(F.col("classification").isin(R.CLASS_HIGH, R.CLASS_INVALID), F.lit(False)).alias("bad"))


def evaluate_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    c = get_default_config()
    rated = metrics(_labelled(spark, folder), [*SWEEP, c.medium_threshold, c.high_threshold])
    return rated.select("threshold", "tp", "fp", "tn", "fn", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


def evaluate_best(spark: SparkSession, folder: str) -> DataFrame:
    return best_row(metrics(_labelled(spark, folder), SWEEP)).select("threshold", "tp", "fp")


def blocklist_hits(spark: SparkSession, folder: str) -> DataFrame:
    """What of the block list, seed and feed, each result matches: its URL, else the longest listed suffix of its host."""
    urls, domains = split_blocklist(table(spark, folder, "blocklist_feed").select(F.col("entry").alias("line")))
    seed = table(spark, folder, "blocklist_seed")
    urls = urls.unionAll(seed.filter("kind = 'url'").select("entry_key")).distinct()
    domains = domains.unionAll(seed.filter("kind = 'domain'").select("entry_key")).distinct()
    r = cut(table(spark, folder, "results").select("result_id", F.coalesce("hostname", F.lit("")).alias("host"), canonical_key(F.col("normalized_url")).alias("key")))
    urls, domains = cut(urls), cut(domains)
    by_url = lookup_join(r.select("result_id", "key"), urls.withColumn("hit", F.lit("url")), "key", how="inner").select("result_id", "hit")
    by_host = lookup_join(r.select("result_id", "host"), match_hosts(r.select("host"), domains), "host", how="inner").select("result_id", F.col("domain").alias("hit"))
    rest = by_host.join(by_url.select("result_id"), "result_id", "left_anti")  # one row an id on both sides
    return by_url.unionAll(rest)


def urls_once(spark: SparkSession, folder: str) -> DataFrame:
    return first_occurrences(table(spark, folder, "results").select(F.col("result_id").alias("ord"), "url"))


def csv_cells(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "results").select("result_id", csv_safe(F.col("url")).alias("cell"))


def dns_latest(spark: SparkSession, folder: str) -> DataFrame:
    s = latest(table(spark, folder, "dns_obs"), "host")
    ips = F.array_sort(F.array_distinct(F.filter(F.coalesce("ips", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    return s.select("host", F.array_join(ips, " ").alias("ips"), "error")


def dns_rules(spark: SparkSession, folder: str) -> DataFrame:
    s = network.dns_table({"dns_obs": table(spark, folder, "dns_obs")}, spark)
    found = network.dns_rules(F.col("ips"), F.col("error"), F.col("global"), F.lit(False))
    return s.select("host", F.explode(found).alias("r")).select("host", "r.rule_id", "r.category", "r.points")


def rdap_ages(spark: SparkSession, folder: str) -> DataFrame:
    s = network.domain_ages(latest(table(spark, folder, "rdap_obs"), "domain"), _now())
    return s.select("domain", "age", "error", network.age_rule(F.col("domain"), F.col("age"), F.col("error"))["rule_id"].alias("rule_id"))


def redirect_walks(spark: SparkSession, folder: str) -> DataFrame:
    """The walk from every distinct normalized URL over the recorded hops; the recorded addresses are all reserved ones."""
    hops = latest(table(spark, folder, "hop_obs"), "url")
    dns = network.dns_table({"dns_obs": table(spark, folder, "dns_obs")}, spark)
    starts = table(spark, folder, "results").select(F.col("normalized_url").alias("start")).filter("start <> ''").distinct()
    w = network.walk(starts, hops, dns, Options(redirects=True, allow_private=True), _now())
    return w.select("start", F.array_join("chain", " ").alias("chain"), "reached", "aborted", "status", F.array_join(F.transform("found", lambda x: x["rule_id"]), " ").alias("rules"))


QUERIES = {
    f.__name__: f
    for f in (
        text_refang,
        text_tokens,
        text_entropy,
        url_schemes,
        url_parts,
        host_domains,
        hosts_parsed,
        rules_path,
        scan_scores,
        score_indicators,
        class_counts,
        evaluate_thresholds,
        evaluate_best,
        blocklist_hits,
        urls_once,
        csv_cells,
        dns_latest,
        dns_rules,
        rdap_ages,
        redirect_walks,
    )
}

# ---------------------------------------------------------------- SQL

_WS = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _refang(x: str) -> str:
    s = f"regexp_replace({_strip(x)}, '^hxxp', 'http', 'i')"
    for old, new in (("[://]", "://"), ("[:]", ":"), ("[.]", "."), ("(.)", "."), ("{.}", "."), ("[/]", "/"), ("[@]", "@")):
        s = f"replace({s}, '{old}', '{new}')"
    return rf"regexp_replace({s}, '\[dot\]|\(dot\)', '.', 'gi')"


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_CLEAN = f"c AS (SELECT result_id, {_refang('url')} AS c, {_strip('url')} AS g FROM results)"
_NORM = rf"""n AS (SELECT result_id, c, regexp_matches(c, '^[a-zA-Z][a-zA-Z0-9+.\-]*://') AS explicit,
    CASE WHEN regexp_matches({_strip("c")}, '^[a-zA-Z][a-zA-Z0-9+.\-]*://') THEN {_strip("c")}
         ELSE 'http://' || regexp_replace({_strip("c")}, '^//', '') END AS normalized FROM c)"""
_U = r"regexp_replace(normalized, '[\t\r\n]', '', 'g')"
_RX = r"'(?s)^([a-zA-Z][a-zA-Z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
_LAST = r"'(?s)^(.*/[^/;]*|[^/;]*);([^/]*)$'"
_SPLIT = f"""p AS (SELECT result_id, normalized, lower(regexp_extract({_U}, {_RX}, 1)) AS scheme, regexp_extract({_U}, {_RX}, 2) AS netloc,
    regexp_extract({_U}, {_RX}, 3) AS p, regexp_extract({_U}, {_RX}, 4) AS query, regexp_extract({_U}, {_RX}, 5) AS fragment FROM n),
  q AS (SELECT *, scheme IN ('ftp', 'hdl', 'prospero', 'http', 'https', 'shttp', 'rtsp', 'rtsps', 'sip', 'sips', 'mms', 'sftp', 'tel') AND regexp_matches(p, {_LAST}) AS has FROM p),
  s AS (SELECT result_id, normalized, scheme, netloc, CASE WHEN has THEN regexp_extract(p, {_LAST}, 1) ELSE p END AS path,
        CASE WHEN has THEN regexp_extract(p, {_LAST}, 2) ELSE '' END AS params, query, fragment FROM q)"""


def _as_number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


#: Conditions on an IPv4 address as a number, ipn.
_V4_PRIVATE = " OR ".join(f"ipn BETWEEN {_as_number(f)} AND {_as_number(f) + 2 ** (32 - bits) - 1}" for f, bits in PRIVATE_V4)
_V4_PUBLIC = ", ".join(str(_as_number(x)) for x in PUBLIC_V4)
_BAD = f"coalesce(classification IN ('{R.CLASS_HIGH}', '{R.CLASS_INVALID}'), false)"
_METRICS = f"""t AS (SELECT unnest(range(5, 100, 5)){{more}}::INTEGER AS threshold),
  m AS (SELECT threshold, count(*) FILTER (WHERE bad AND hit)::INTEGER AS tp, count(*) FILTER (WHERE NOT bad AND hit)::INTEGER AS fp,
               count(*) FILTER (WHERE NOT bad AND NOT hit)::INTEGER AS tn, count(*) FILTER (WHERE bad AND NOT hit)::INTEGER AS fn
        FROM (SELECT threshold, {_BAD} AS bad, coalesce(score >= threshold, false) AS hit FROM t, results) GROUP BY threshold),
  r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS recall FROM m),
  f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r)"""

SQL = {
    "text_refang": f"WITH {_CLEAN} SELECT result_id, c AS cleaned, c <> g AS defanged FROM c",
    "text_tokens": "SELECT result_id, array_to_string(list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS tokens FROM results",
    "text_entropy": """
        WITH c AS (SELECT host_id, length(host)::DOUBLE AS n, unnest(string_split(host, '')) AS ch FROM hostinfo WHERE host <> ''),
        k AS (SELECT host_id, n, ch, count(*) AS k FROM c GROUP BY ALL),
        e AS (SELECT host_id, sum(-(k / n) * log2(k / n)) AS e FROM k GROUP BY host_id)
        SELECT host_id, CASE WHEN host = '' THEN 0.0 ELSE round(e, 6) END AS entropy FROM hostinfo LEFT JOIN e USING (host_id)
    """,
    "url_schemes": rf"""WITH {_CLEAN}, {_NORM}, m AS (SELECT *, lower(regexp_extract(c, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1)) AS m FROM n)
        SELECT result_id, CASE WHEN m IN ({_list(R.DANGEROUS_SCHEMES)}) OR (NOT explicit AND m IN ({_list(R.NON_WEB_SCHEMES)})) THEN m END AS special, normalized, explicit FROM m""",
    "url_parts": f"WITH {_CLEAN}, {_NORM}, {_SPLIT} SELECT result_id, scheme, netloc, path, params, query, fragment FROM s",
    "host_domains": f"""
        WITH l AS (SELECT host_id, host, string_split(host, '.') AS l FROM hostinfo),
        k AS (SELECT *, CASE WHEN len(l) > 2 AND l[-2] || '.' || l[-1] IN ({_list(R.KNOWN_SUFFIXES)}) THEN 2 ELSE 1 END AS k FROM l)
        SELECT host_id, CASE WHEN len(l) < 2 THEN '' ELSE array_to_string(l[1:len(l) - k - 1], '.') END AS subdomain,
               CASE WHEN len(l) < 2 THEN host ELSE l[len(l) - k] END AS sld,
               CASE WHEN len(l) < 2 THEN '' ELSE array_to_string(l[len(l) - k + 1:len(l)], '.') END AS suffix FROM k
    """,
    "rules_path": f"""
        WITH {_CLEAN}, {_NORM}, {_SPLIT},
        v AS (SELECT result_id, length(normalized) AS n, length(query) AS ql, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS segs,
                     len(list_filter(regexp_split_to_array(query, '[&;]'), lambda x: x <> '')) AS pars FROM s)
        SELECT result_id, CASE WHEN n > 200 THEN 'R03' WHEN n > 150 THEN 'R04' ELSE 'R05' END AS rule_id, 'structure' AS category,
               CASE WHEN n > 200 THEN 15 WHEN n > 150 THEN 10 ELSE 5 END AS points FROM v WHERE n > 100
        UNION ALL SELECT result_id, CASE WHEN segs >= 8 THEN 'R70' ELSE 'R71' END, 'structure', CASE WHEN segs >= 8 THEN 10 ELSE 5 END FROM v WHERE segs >= 5
        UNION ALL SELECT result_id, CASE WHEN pars >= 10 THEN 'R72' ELSE 'R73' END, 'structure', CASE WHEN pars >= 10 THEN 10 ELSE 5 END FROM v WHERE pars >= 6
        UNION ALL SELECT result_id, 'R74', 'structure', 8 FROM v WHERE ql > 500
    """,
    "score_indicators": f"""
        WITH i AS (SELECT result_id, allowlisted, unnest(indicators) AS i, generate_subscripts(indicators, 1) AS pos FROM results),
        c AS (SELECT result_id, any_value(allowlisted) AS a, i.category AS cat, min(pos) AS pos, sum(i.points) AS p FROM i WHERE i.points > 0 GROUP BY result_id, i.category),
        k AS (SELECT result_id, pos, cat, a, least(p, CASE cat {" ".join(f"WHEN '{k}' THEN {v}" for k, v in R.CATEGORY_CAPS.items())} ELSE p END)::DOUBLE AS p FROM c),
        s AS (SELECT result_id, list_reduce(list(CASE WHEN a AND cat IN ({_list(R.SOFT_CATEGORIES)}) THEN p * 0.35::DOUBLE ELSE p END ORDER BY pos), lambda x, y: x + y) AS s FROM k GROUP BY result_id),
        f AS (SELECT result_id, max(i.points) >= 100 AS f FROM i GROUP BY result_id)
        SELECT result_id, CASE WHEN coalesce(f, false) THEN 100 ELSE least(coalesce(round_even(s, 0), 0), 100)::INTEGER END AS total
        FROM results LEFT JOIN s USING (result_id) LEFT JOIN f USING (result_id)
    """,
    "class_counts": f"SELECT CASE WHEN score >= 60 THEN '{R.CLASS_HIGH}' WHEN score >= 30 THEN '{R.CLASS_MEDIUM}' ELSE '{R.CLASS_LOW}' END AS class, count(*) AS rows FROM results GROUP BY 1",
    "evaluate_thresholds": f"WITH {_METRICS.format(more='')} SELECT threshold, tp, fp, tn, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f",
    "evaluate_best": f"WITH {_METRICS.format(more='')} SELECT threshold, tp, fp FROM f ORDER BY f1 DESC, threshold DESC LIMIT 1",
    "blocklist_hits": rf"""
        WITH l AS (SELECT {_strip("entry")} AS e FROM blocklist_feed), b AS (SELECT {_refang("e")} AS e FROM l WHERE e <> '' AND NOT starts_with(e, '#')),
        u AS (SELECT rtrim(lower(regexp_replace(e, '^[a-z][a-z0-9+.-]*://', '', 'i')), '/') AS key FROM b WHERE regexp_matches(e, '[/?]')
              UNION SELECT entry_key FROM blocklist_seed WHERE kind = 'url'),
        d AS (SELECT rtrim(lower(e), '.') AS domain FROM b WHERE NOT regexp_matches(e, '[/?]')
              UNION SELECT entry_key FROM blocklist_seed WHERE kind = 'domain'),
        r AS (SELECT result_id, hostname, rtrim(lower(regexp_replace({_refang("normalized_url")}, '^[a-z][a-z0-9+.-]*://', '', 'i')), '/') AS key FROM results),
        h AS (SELECT DISTINCT hostname, string_split(hostname, '.') AS l FROM results WHERE hostname <> ''),
        x AS (SELECT hostname, i, array_to_string(l[i:len(l)], '.') AS domain FROM h, unnest(range(1, len(l) + 1)) AS g(i)),
        m AS (SELECT hostname, arg_min(domain, i) AS domain FROM x JOIN d USING (domain) GROUP BY hostname)
        SELECT result_id, CASE WHEN u.key IS NOT NULL THEN 'url' ELSE domain END AS hit
        FROM r LEFT JOIN u USING (key) LEFT JOIN m USING (hostname) WHERE u.key IS NOT NULL OR domain IS NOT NULL
    """,
    "urls_once": f"WITH u AS (SELECT result_id, {_strip('url')} AS url FROM results) SELECT min(result_id) AS ord, url FROM u WHERE url <> '' AND NOT starts_with(url, '#') GROUP BY url",
    "dns_latest": """
        WITH o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY obs_ts DESC NULLS LAST, obs_id DESC) AS rn FROM dns_obs WHERE host IS NOT NULL)
        SELECT host, array_to_string(list_sort(list_distinct(list_filter(coalesce(ips, []), lambda x: x IS NOT NULL))), ' ') AS ips, error FROM o WHERE rn = 1
    """,
    "csv_cells": r"""
        WITH c AS (SELECT result_id, array_to_string(list_transform(string_split(url, ''), lambda x: CASE WHEN NOT regexp_matches(x, '[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]') THEN x
                     WHEN unicode(x) <= 255 THEN '\x' || printf('%02x', unicode(x)) ELSE '\u' || printf('%04x', unicode(x)) END), '') AS c FROM results)
        SELECT result_id, CASE WHEN c[1] IN ('=', '+', '-', '@') THEN chr(39) || c ELSE c END AS cell FROM c
    """,
    "dns_rules": f"""
        WITH o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY obs_ts DESC NULLS LAST, obs_id DESC) AS rn FROM dns_obs WHERE host IS NOT NULL),
        l AS (SELECT host, error, list_distinct(list_filter(coalesce(ips, []), lambda x: x IS NOT NULL)) AS ips FROM o WHERE rn = 1),
        a AS (SELECT host, unnest(ips) AS ip FROM l),
        p AS (SELECT host, ip, CASE WHEN regexp_matches(ip, '^(::ffff:)?[0-9.]+$') THEN list_reduce(list_transform(string_split(replace(ip, '::ffff:', ''), '.'), lambda x: x::BIGINT), lambda x, y: x * 256 + y) END AS ipn FROM a),
        g AS (SELECT host, bool_or(coalesce(({_V4_PRIVATE}) AND ipn NOT IN ({_V4_PUBLIC}), regexp_matches(ip, '^(2001:db8:|::1?$|fe[89ab]|f[cd])'))) AS inner_ip FROM p GROUP BY host),
        f AS (SELECT host, ips, error IS NOT NULL OR len(ips) = 0 AS failed, coalesce(inner_ip, false) AS inner_ip FROM l LEFT JOIN g USING (host))
        SELECT host, 'N01' AS rule_id, 'dns' AS category, 8 AS points FROM f WHERE failed
        UNION ALL SELECT host, 'N02', 'dns', 10 FROM f WHERE NOT failed AND inner_ip
        UNION ALL SELECT host, 'N03', 'dns', 5 FROM f WHERE NOT failed AND len(ips) > 8
    """,
    "rdap_ages": f"""
        WITH o AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY obs_ts DESC NULLS LAST, obs_id DESC) AS rn FROM rdap_obs WHERE domain IS NOT NULL),
        l AS (SELECT domain, error, events FROM o WHERE rn = 1),
        e AS (SELECT domain, unnest(events) AS e, generate_subscripts(events, 1) AS i FROM l),
        d AS (SELECT domain, i, e.eventDate AS d FROM e WHERE e.eventAction = 'registration'
                AND regexp_full_match(e.eventDate, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(Z|[+-][0-9]{{2}}:[0-9]{{2}})?)?')),
        t AS (SELECT domain, i, try_cast(substr(d, 1, 19) AS TIMESTAMP) - to_minutes(CASE WHEN length(d) > 20
                THEN (CASE WHEN substr(d, 20, 1) = '-' THEN -1 ELSE 1 END) * (substr(d, 21, 2)::INTEGER * 60 + substr(d, 24, 2)::INTEGER) ELSE 0 END) AS t FROM d),
        r AS (SELECT domain, arg_min(t, i) AS t FROM t WHERE t IS NOT NULL GROUP BY domain),
        a AS (SELECT domain, CASE WHEN error IS NULL AND t IS NOT NULL THEN greatest(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(t)) / 86400000000), 0)::INTEGER END AS age, error FROM l LEFT JOIN r USING (domain)),
        x AS (SELECT domain, age, coalesce(error, CASE WHEN age IS NULL THEN 'no registration date' END) AS error FROM a)
        SELECT domain, age, error, CASE WHEN error IS NOT NULL THEN 'N33' WHEN age < 30 THEN 'N30' WHEN age < 90 THEN 'N31' WHEN age < 180 THEN 'N32' END AS rule_id FROM x
    """,
}
