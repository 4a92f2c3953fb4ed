"""The rule catalogue as queries with SQL: hits, scores and hosts of every URL that SQL can decode.

SQL has no Unicode normalisation, punycode or IPv6, so the queries take the URLs that need none: those of ASCII
characters, without xn-- names, square brackets and escapes beyond ASCII. CASES adds a hit and a near miss of each rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import refdata as R
from ..config import Options, get_default_config
from ..functions.text import refang
from ..functions.urls import parse
from ..operators import network
from ..runtime import table
from ..sources.observations import latest
from .analyze import analyze
from .queries import _CLEAN, _NORM, _SPLIT, _V4_PRIVATE, _V4_PUBLIC, NOW, _list, _refang

_PLAIN = r"^[\x01-\x7f]*$"
_BEYOND = r"(?i)xn--|%[89a-f]|%5[bd]|%00|[\[\]]"

_VISIBLE = r"^[\x21-\x7e]*$"
_BEYOND_WALK = r"(?i)xn--|[\[\]]|^[^/?#]*//[^/?#]*%"

#: URLs beside those of the table, a hit and near misses of each rule.
CASES = [
    # scheme, length
    "example.com", "https://example.com", "http://example.com", "HTTP://Example.COM/", "ftp://example.com/x", "hxxps://exa[.]mple(dot)com", "javascript:alert(1)", "data:text/html,x", "mailto:a@example.com", "mailto://example.com",
    "tel:123", "sms:1", "blob:x", "file:///etc/passwd", "http://", "https:///path", "//example.com/a", "http://?q", "http://.../",
    "https://example.com/" + "a" * 80, "https://example.com/" + "a" * 81, "https://example.com/" + "b" * 130, "https://example.com/" + "b" * 131, "https://example.com/" + "c" * 180, "https://example.com/" + "c" * 181,
    # deception
    "https://user@example.com", "https://paypal@example.com/", "https://www.paypal.com@example.com/", "https://pay%70al@example.com/", "ftp://paypal@example.com", "https://a@b@example.com:80/",
    "http://8.8.8.8/", "http://134744072/", "http://0x8.8.8.8/", "http://010.8.8.8/", "http://08.8.8.8/", "http://10.0.0.1/", "http://192.0.0.9/", "http://192.0.0.8/", "http://127.1/", "http://1.2.3.256/", "http://4294967296/", "http://4294967295/", "http://1.2.3.4.5/", "http://0x/", "http://1.2.65536/", "http://1.16777215/",
    "https://example.com\\evil", "https://exam ple.com/", "https://exam\x07ple.com/a", "https://localhost/", "https://under_score.example.com/", "https://exa!mple.com",
    # host
    "https://a.b.c.d.example.com/", "https://a.b.c.example.com/", "https://a.b.example.com/", "https://a.example.com/", "https://a.b.example.co.uk/", "https://co.uk/", "https://a-b-c-d-e-f.com/", "https://a-b-c-d.com/", "https://a-b-c.com/",
    "https://a123456.com/", "https://a12345.com/", "https://a---b.com/", "https://a.-.b.com/", "https://a--b.com/", "https://xkqzvbnwtrpl.com/", "https://q1w2e3r4t5y6.com/", "https://aaaaaaaaaaaa.com/", "https://bookshoponline.com/", "https://xkqzvbnwt.com/",
    # lexical
    "https://login.example.com/", "https://mylogins.example.com/", "https://verifyaccount-secure.example.com/", "https://verification-password-credential-wallet.com/", "https://signins.example.com/", "https://example.com/login/verify?update=password", "https://example.com/logins", "https://example.com/account/bank/x",
    "https://example.com/http://evil.test/", "https://example.com/?u=https%3A%2F%2Fevil.test", "https://example.com/?q=https%253A%252F%252Fx.test", "https://example.com/#http:/x", "https://example.com/?next=1", "https://example.com/?NEXT=//evil.test/x", "https://example.com/?next=//www.example.com/x", "https://example.com/?xnext=//evil.test", "https://example.com/?next=https://evil.test:80/a&r=1",
    "https://example.com/?url=//user@1.2.3.4/", "https://example.com/?u=%2F%2Fevil.co.uk.&goto=//other.test", "https://example.com/?re%74urn=http://evil.test", "https://example.com/?next=evil.test", "https://example.com/?next=http:evil", "https://1.2.3.4/login?verify=1",
    # hosting, encoding, ports
    "https://bit.ly/x", "https://sub.bit.ly/x", "https://notbit.ly/x", "https://someone.github.io/", "https://github.io/", "https://sites.google.com/view/x", "https://docs.google.com.evil.test/", "https://x.blob.core.windows.net/a", "https://example.xyz/", "https://example.zip/", "https://xyz.com/", "https://a.b.top/",
    "https://exa%6dple.com/", "https://us%65r@example.com/", "https://example.com/%41", "https://example.com/%2E%2e/", "https://example.com/%2f%2F", "https://example.com/%5C", "https://example.com/%25", "https://example.com/%20%2d", "https://example.com/a//b", "https://example.com//", "https://example.com/?//",
    "https://example.com:8080/", "https://example.com:443/", "https://example.com:81/", "https://example.com:0/", "https://example.com:65535/", "https://example.com:65536/", "https://example.com:x/", "https://example.com:/", "https://example.com:00022/", "https://example.com:80:90/",
    # path, payload
    "https://example.com/1/2/3/4/5", "https://example.com/1/2/3/4", "https://example.com/1/2/3/4/5/6/7/8", "https://example.com/1/2/3/4/5/6/7", "https://example.com/?a&b&c&d&e&f", "https://example.com/?a;b;c;d;e", "https://example.com/?1&2&3&4&5&6&7&8&9&0", "https://example.com/?" + "q" * 501, "https://example.com/?" + "q" * 500,
    "https://example.com/a.exe", "https://example.com/a.zip", "https://example.com/a.pdf.exe", "https://example.com/a.pdf.zip", "https://example.com/a.exe.pdf", "https://example.com/exe", "https://example.com/a.exe;x=1", "https://example.com/a.e%78e", "https://example.com/x.exe/", "https://example.com/.exe", "https://example.com/a.doc.txt", "https://example.com/a.EXE",
    # brands
    "https://paypal.com.evil.test/", "https://www.paypal.com/", "https://paypal.evil.test/", "https://my-paypal.test/", "https://mypaypals.test/", "https://evil.test/paypal", "https://paypa1.test/", "https://paypai.test/", "https://payypal.test/", "https://paypla.test/", "https://paaypaal.test/", "https://micr0soft.test/", "https://mircosoft.test/", "https://micosfot.test/", "https://rnicrosoft.test/",
    "https://apple.test/", "https://evil.test/apple", "https://apple.evil.test/", "https://appie.test/", "https://chase.bank.test/", "https://google.co.in.login.test/", "https://amazon-paypal-google.test/login", "https://paypal.test/login/verify", "https://face-book.test/", "https://pay-pal.test/", "https://dhl.test/", "https://dh1.test/", "https://onlinesbi.com.x.test/", "https://mail.google.com/paypal", "https://gooogle.test/", "https://evil.test/chase?login",
    "https://youtube.com/login?next=//evil.test/a/b/c/d/e//f.exe", "https://login.wikipedia.org:8080/verify//1/2/3/4/5", "https://wikipedia.org/", "https://x.sharepoint.com/", "https://stripe.com/a.pdf.exe",
]


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = refang(F.col("url"))
    given = table(spark, folder, "results").select("result_id", "url").filter(cleaned.rlike(_PLAIN) & ~cleaned.rlike(_BEYOND))
    return given.unionAll(spark.createDataFrame([(-1 - i, u) for i, u in enumerate(CASES)], "result_id bigint, url string"))


def rule_hits(spark: SparkSession, folder: str) -> DataFrame:
    """(result_id, rule_id, category, points): every indicator of the offline scan; nulls for a URL without any."""
    out = analyze(_corpus(spark, folder), "url", keep=["result_id"])
    # explode() would have Spark infer a filter on the array and carry it, all rules expanded, down to the scan
    hits = out.select("result_id", F.explode_outer("indicators").alias("i")).select("result_id", "i.rule_id", "i.category", "i.points")
    return hits


def rule_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(result_id, allowlisted, score, classification) of the offline scan."""
    return analyze(_corpus(spark, folder), "url", keep=["result_id"]).select("result_id", "allowlisted", "score", "classification")


def host_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The host columns of the parse stage; '' for URLs without a host."""
    s = parse(_corpus(spark, folder), "url")
    shown: list[Column] = [F.col(c) for c in ("valid", "host", "is_ip", "ip", "obfuscated_ip", "ip_private", "subdomain", "sld", "suffix", "registered_domain", "free_hosting", "port", "port_invalid", "username")]
    return s.filter(F.col("special").isNull()).select("result_id", *shown)


def plain_walks(spark: SparkSession, folder: str) -> DataFrame:
    """The walk from every normalized URL over the hops, as redirect_walks, where SQL can read both."""
    plain = lambda c: c.rlike(_VISIBLE) & ~c.rlike(_BEYOND_WALK)
    hops = latest(table(spark, folder, "hop_obs"), "url").filter(plain(F.col("url")) & plain(F.coalesce("location", F.lit(""))))
    dns = network.dns_table({"dns_obs": table(spark, folder, "dns_obs")}, spark)
    starts = table(spark, folder, "results").select(F.col("normalized_url").alias("start")).filter((F.col("start") != "") & plain(F.col("start"))).distinct()
    w = network.walk(starts, hops, dns, Options(redirects=True, allow_private=True), F.lit(NOW).cast("timestamp"))
    return w.select("start", F.array_join("chain", " ").alias("chain"), "reached", "status", F.array_join(F.transform("found", lambda x: x["rule_id"]), " ").alias("rules"))


QUERIES = {f.__name__: f for f in (rule_hits, rule_scores, host_parts, plain_walks)}

# ---------------------------------------------------------------- SQL


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _array(words) -> str:
    return f"[{_quoted(words)}]"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"


def _decode(x: str) -> str:
    return f"url_decode(replace({x}, '+', '%2B'))"


_CASES = ", ".join(f"({-1 - i}, {_quoted([u])})" for i, u in enumerate(CASES))
_OCTAL = "list_reduce(list_transform(string_split(x, ''), lambda d: d::HUGEINT), lambda a, d: a * 8 + d)"
_DIGITS = "list_position(string_split('0123456789abcdef', ''), d) - 1"
_HEX = f"list_reduce(list_transform(string_split(substr(x, 3), ''), lambda d: ({_DIGITS})::HUGEINT), lambda a, d: a * 16 + d)"

#: All hosts (of URLs and of parameter values) with address, domain parts and suffixes.
_HOSTS = f"""
  h1 AS (SELECT host, string_split(host, '.') AS l,
           regexp_matches(host, '^(?:0x[0-9a-f]{{1,25}}|[0-9]{{1,30}})(?:\\.(?:0x[0-9a-f]{{1,25}}|[0-9]{{1,30}})){{0,3}}$') AS numeric FROM (SELECT DISTINCT host FROM named)),
  h2 AS (SELECT *, CASE WHEN numeric THEN list_transform(l, lambda x: CASE WHEN starts_with(x, '0x') THEN {_HEX}
             WHEN regexp_matches(x, '^0[0-9]+$') THEN CASE WHEN regexp_matches(x, '^[0-7]+$') THEN {_OCTAL} END ELSE x::HUGEINT END) END AS n FROM h1),
  h3 AS (SELECT *, CASE WHEN numeric AND len(list_filter(n, lambda x: x IS NULL)) = 0 AND len(list_filter(n[1:len(n) - 1], lambda x: x > 255)) = 0
                         AND n[len(n)] < 256::HUGEINT ** (5 - len(n)) THEN (n[len(n)] + coalesce(n[1] * CASE WHEN len(n) > 1 THEN 16777216 ELSE 0 END, 0)
                         + coalesce(n[2] * CASE WHEN len(n) > 2 THEN 65536 ELSE 0 END, 0) + coalesce(n[3] * CASE WHEN len(n) > 3 THEN 256 ELSE 0 END, 0))::BIGINT END AS ipn FROM h2),
  h4 AS (SELECT host, l, ipn, ipn IS NOT NULL AS is_ip, CASE WHEN len(l) > 2 AND l[-2] || '.' || l[-1] IN ({_list(R.KNOWN_SUFFIXES)}) THEN 2 ELSE 1 END AS k,
                list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:len(l)], '.')) AS ups FROM h3),
  h5 AS (SELECT *, CASE WHEN is_ip OR len(l) < 2 THEN '' ELSE array_to_string(l[1:len(l) - k - 1], '.') END AS subdomain,
                CASE WHEN is_ip THEN '' WHEN len(l) < 2 THEN host ELSE l[len(l) - k] END AS sld,
                CASE WHEN is_ip OR len(l) < 2 THEN '' ELSE array_to_string(l[len(l) - k + 1:len(l)], '.') END AS suffix FROM h4),
  hosts AS (SELECT *, CASE WHEN is_ip THEN host WHEN suffix = '' THEN sld ELSE sld || '.' || suffix END AS reg,
                   is_ip AND NOT regexp_matches(host, '^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\\.|$)){{4}}$') AS odd_ip,
                   is_ip AND ({_V4_PRIVATE}) AND ipn NOT IN ({_V4_PUBLIC}) AS private FROM h5)"""

#: Parsed URLs with the facts of their hosts.
_PARSED = f"""
  given AS (SELECT result_id, url FROM results WHERE regexp_matches({_refang("url")}, '{_PLAIN}') AND NOT regexp_matches({_refang("url")}, '{_BEYOND}')
            UNION ALL SELECT * FROM (VALUES {_CASES}) v(result_id, url)),
  {_CLEAN.replace("FROM results", "FROM given")}, {_NORM}, {_SPLIT},
  b AS (SELECT s.*, c.c, c.c <> c.g AS defanged, n.explicit, lower(regexp_extract(c.c, '^([a-zA-Z][a-zA-Z0-9+.\\-]*):', 1)) AS m,
               regexp_extract(netloc, '(?s)^(.*)@', 1) AS info, regexp_replace(netloc, '(?s)^.*@', '') AS bare FROM s JOIN c USING (result_id) JOIN n USING (result_id)),
  p0 AS (SELECT *, split_part(info, ':', 1) AS username, rtrim(lower(split_part(bare, ':', 1)), '.') AS host, regexp_extract(bare, '(?s)^[^:]*:(.*)$', 1) AS port_text,
                CASE WHEN m IN ({_list(R.DANGEROUS_SCHEMES)}) OR (NOT explicit AND m IN ({_list(R.NON_WEB_SCHEMES)})) THEN m END AS special FROM b),
  p1 AS (SELECT *, CASE WHEN regexp_matches(port_text, '^0*[0-9]{{1,5}}$') AND port_text::HUGEINT <= 65535 THEN port_text::INTEGER END AS port FROM p0),
  pairs AS (SELECT result_id, pos, lower(url_decode(split_part(kv, '=', 1))) AS key,
                   {_decode("url_decode(CASE WHEN contains(kv, '=') THEN regexp_replace(kv, '(?s)^[^=]*=', '') ELSE '' END)")} AS v
            FROM (SELECT result_id, unnest(string_split(query, '&')) AS kv, generate_subscripts(string_split(query, '&'), 1) AS pos FROM p1) WHERE kv <> ''),
  leads AS (SELECT *, rtrim(split_part(lower(regexp_replace(regexp_extract(v, '(?s)^(?:https?:)?//([^/?#]*)', 1), '(?s)^.*@', '')), ':', 1), '.') AS host
            FROM pairs WHERE key IN ({_list(R.REDIRECT_PARAMS)})),
  named AS (SELECT host FROM p1 UNION ALL SELECT host FROM leads),
  {_HOSTS},
  away AS (SELECT lead.result_id, bool_or(lead.host <> '' AND there.reg <> here.reg) AS off_site
           FROM leads lead JOIN hosts there ON there.host = lead.host JOIN p1 ON p1.result_id = lead.result_id JOIN hosts here ON here.host = p1.host GROUP BY lead.result_id)"""

_COUNT = "length(regexp_replace({0}, '[^{1}]', '', 'g'))"
_BRANDS = ", ".join(f"({i}, '{b}', {_array(sorted(d))}, {str(b in R.AMBIGUOUS_BRANDS).lower()})" for i, (b, d) in enumerate(R.BRANDS.items()))


def _skeleton(x: str) -> str:
    return f"replace(replace(translate(replace({x}, '-', ''), '{R.SKELETON_FROM}', '{R.SKELETON_TO}'), 'rn', 'm'), 'vv', 'w')"


#: What the rules look at, one row a URL that isn't special and has a host.
_FACTS = f"""
  f0 AS (SELECT p1.*, h.is_ip, h.ipn, h.odd_ip, h.private, h.subdomain, h.sld, h.suffix, h.reg, h.ups, NOT h.is_ip AND h.suffix IN ({_list(R.FREE_HOSTING_SUFFIXES)}) AS free,
                list_has_any(h.ups, {_array(R.USER_CONTENT_HOSTS)}) AS user_content, {_decode(_decode("path || '?' || query || '#' || fragment"))} AS embedded,
                lower({_decode("path")}) AS path_text, lower({_decode("query")}) AS query_text, lower({_decode("username")}) AS user_text,
                replace(h.sld, '-', '') AS r, regexp_replace(p1.host, '[^a-z0-9]', '', 'g') AS compact
         FROM p1 JOIN hosts h USING (host) WHERE special IS NULL AND p1.host <> ''),
  f1 AS (SELECT *, CASE WHEN is_ip THEN [] ELSE {_tokens("host")} END AS host_tokens, list_concat({_tokens("path_text")}, {_tokens("query_text")}) AS path_tokens,
                regexp_extract(path_text, '[^/]*$') AS file, NOT is_ip AND NOT free AND NOT user_content AND reg IN ({_list(sorted(get_default_config().allowlist))}) AS allowlisted,
                len(list_filter(string_split(subdomain, '.'), lambda x: x <> '')) AS depth, {_COUNT.format("host", "-")} AS hyphens,
                len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS segments, len(list_filter(regexp_split_to_array(query, '[&;]'), lambda x: x <> '')) AS nparams FROM f0),
  f2 AS (SELECT *, CASE WHEN contains(file, '.') THEN string_split(file, '.')[2:] ELSE [] END AS exts,
                len(list_filter({_array(R.KEYWORDS_STRONG)}, lambda w: NOT is_ip AND (list_contains(host_tokens, w) OR (length(w) >= 6 AND contains(compact, w))))) AS sh,
                len(list_filter({_array(R.KEYWORDS_WEAK)}, lambda w: NOT is_ip AND (list_contains(host_tokens, w) OR (length(w) >= 6 AND contains(compact, w))))) AS wh,
                len(list_filter({_array(R.KEYWORDS_STRONG)}, lambda w: list_contains(path_tokens, w))) AS sp, len(list_filter({_array(R.KEYWORDS_WEAK)}, lambda w: list_contains(path_tokens, w))) AS wp,
                length(r) >= 10 AND ({_COUNT.format("r", "a-zA-Z")} = 0 OR {_COUNT.format("r", "aeiou")} / greatest({_COUNT.format("r", "a-zA-Z")}, 1)::DOUBLE <= 0.2
                  OR (regexp_matches(r, '[a-z][0-9]+[a-z]') AND {_COUNT.format("r", "0-9")} >= 2)) AS odd FROM f1),
  letters AS (SELECT DISTINCT r, unnest(string_split(r, '')) AS ch, generate_subscripts(string_split(r, ''), 1) AS i FROM (SELECT DISTINCT r FROM f2 WHERE odd)),
  entropies AS (SELECT r, sum(-k / n * log2(k / n)) AS entropy FROM (SELECT r, length(r)::DOUBLE AS n, count(*)::DOUBLE AS k FROM letters GROUP BY r, ch) GROUP BY r),
  f AS (SELECT f2.*, exts[-1] AS last, CASE WHEN len(exts) > 1 THEN exts[-2] END AS before, coalesce(odd AND entropy >= 3.2, false) AS random, split_part(suffix, '.', -1) AS tld,
               EXISTS (SELECT 1 FROM leads WHERE leads.result_id = f2.result_id) AS redirects, coalesce(off_site, false) AS off_site
        FROM f2 LEFT JOIN entropies USING (r) LEFT JOIN away USING (result_id)),
  brand(ord, brand, domains, ordinary) AS (VALUES {_BRANDS}),
  lab AS (SELECT result_id, sld AS label, ups, reg FROM f WHERE NOT is_ip UNION SELECT result_id, replace(sld, '-', ''), ups, reg FROM f WHERE NOT is_ip),
  arms AS (
    SELECT result_id, ord, 'BR-1' AS arm, 40 AS points FROM f, brand WHERE NOT is_ip AND contains(subdomain, '.') AND len(list_filter(domains, lambda d: contains('.' || subdomain || '.', '.' || d || '.'))) > 0
    UNION ALL SELECT result_id, ord, CASE WHEN list_contains({_tokens("subdomain")}, brand) THEN 'BR-2' WHEN list_contains({_tokens("sld")}, brand) THEN 'BR-3' ELSE 'BR-4' END,
        CASE WHEN list_contains({_tokens("subdomain")}, brand) THEN 40 WHEN list_contains({_tokens("sld")}, brand) THEN 35 ELSE 22 END
        FROM f, brand WHERE NOT is_ip AND contains(compact, brand) AND (list_contains({_tokens("subdomain")}, brand) OR list_contains({_tokens("sld")}, brand)
          OR (length(brand) >= 6 AND (contains(regexp_replace(subdomain, '[^a-z0-9]', '', 'g'), brand) OR contains(regexp_replace(sld, '[^a-z0-9]', '', 'g'), brand))))
    UNION ALL SELECT result_id, ord, 'BR-6', 40 FROM lab, brand WHERE label <> brand AND length(brand) >= 4 AND {_skeleton("label")} = {_skeleton("brand")}
    UNION ALL SELECT result_id, ord, 'BR-7', 30 FROM lab, brand WHERE label <> brand AND {_skeleton("label")} <> {_skeleton("brand")} AND length(brand) >= 6 AND abs(length(label) - length(brand)) <= 2
        AND damerau_levenshtein(label, brand) <= CASE WHEN length(brand) >= 9 THEN 2 ELSE 1 END
    UNION ALL SELECT result_id, ord, 'BR-8', 12 FROM f, brand WHERE NOT is_ip AND list_contains(path_tokens, brand)),
  weighed AS (SELECT DISTINCT a.result_id, a.ord, arm, CASE WHEN ordinary AND arm <> 'BR-6' THEN greatest(points - 15, 8) ELSE points END AS points
              FROM arms a JOIN brand USING (ord) JOIN f USING (result_id) WHERE NOT (list_contains(domains, f.reg) OR list_has_any(domains, f.ups[2:]))),
  best AS (SELECT *, row_number() OVER (PARTITION BY result_id, ord ORDER BY arm = 'BR-8', points DESC, arm) AS rn FROM weighed),
  top AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY points DESC, ord) AS place FROM best WHERE rn = 1)"""

#: (place in the order of emission, rule, category, points, condition over f).
_RULES = [
    (1, "I1", "info", "0", "defanged"),
    (2, "R00", "info", "0", "NOT explicit"),
    (3, "R01", "transport", "10", "explicit AND scheme = 'http'"),
    (4, "R02", "transport", "15", "explicit AND scheme NOT IN ('http', 'https')"),
    (5, "R03", "structure", "15", "length(normalized) > 200"),
    (6, "R04", "structure", "10", "length(normalized) BETWEEN 151 AND 200"),
    (7, "R05", "structure", "5", "length(normalized) BETWEEN 101 AND 150"),
    (10, "R10", "deception", "25", "contains(netloc, '@') AND scheme IN ('http', 'https')"),
    (11, "R11", "deception", "25", f"contains(netloc, '@') AND scheme IN ('http', 'https') AND (regexp_matches(user_text, '[a-z0-9-]+\\.[a-z]{{2,}}') OR list_has_any({_tokens('user_text')}, {_array(R.BRANDS)}))"),
    (12, "R12", "deception", "25", "is_ip"),
    (13, "R13", "deception", "20", "is_ip AND odd_ip"),
    (14, "R14", "info", "0", "is_ip AND NOT odd_ip AND private"),
    (18, "R18", "deception", "20", "regexp_matches(c, '[\\x00-\\x1f\\x7f]')"),
    (19, "R19", "deception", "10", "contains(c, '\\')"),
    (20, "R20", "deception", "10", "NOT is_ip AND regexp_matches(host, '[^a-z0-9._-]')"),
    (21, "R21", "structure", "10", "NOT is_ip AND NOT contains(host, '.')"),
    (22, "R22", "structure", "15", "NOT is_ip AND depth >= 4"),
    (23, "R23", "structure", "10", "NOT is_ip AND depth = 3"),
    (24, "R24", "structure", "3", "NOT is_ip AND depth = 2"),
    (25, "R25", "structure", "12", "NOT is_ip AND hyphens >= 5"),
    (26, "R26", "structure", "8", "NOT is_ip AND hyphens IN (3, 4)"),
    (27, "R27", "structure", "10", "NOT is_ip AND " + _COUNT.format("host", "0-9") + " >= 6"),
    (28, "R28", "structure", "8", "NOT is_ip AND regexp_matches(host, '[._-]{{3}}')".replace("{{", "{").replace("}}", "}")),
    (29, "R29", "structure", "10", "NOT is_ip AND random"),
    (30, "R30", "lexical", "least(6 * sh + 3 * wh, 20)", "sh + wh > 0"),
    (31, "R31", "lexical", "least(3 * sp + wp, 8)", "sp + wp > 0"),
    (32, "R32", "lexical", "15", "regexp_matches(lower(embedded), 'https?://')"),
    (33, "R33", "lexical", "10", "redirects"),
    (34, "R34", "lexical", "10", "off_site"),
    (40, "R40", "hosting", "20", f"NOT is_ip AND (host IN ({_list(R.SHORTENERS)}) OR reg IN ({_list(R.SHORTENERS)}))"),
    (41, "R41", "hosting", "8", "free"),
    (42, "R42", "hosting", "5", "NOT is_ip AND user_content"),
    (43, "R43", "hosting", "12", f"NOT is_ip AND tld IN ({_list(R.SUSPICIOUS_TLDS)})"),
    (50, "R50", "structure", "15", "contains(bare, '%')"),
    (51, "R51", "structure", "8", "regexp_matches(lower(path), '%25|%3[0-9]|%[46][1-9a-f]|%[57][0-9a]|%2e%2e|%2f%2f|%5c')"),
    (52, "R52", "structure", "8", "contains(path, '//')"),
    (60, "R60", "transport", "10", "port_text <> '' AND port IS NULL"),
    (61, "R61", "transport", "8", f"port IN ({', '.join(map(str, R.SUSPICIOUS_PORTS))})"),
    (62, "R62", "transport", "4", f"port > 0 AND port NOT IN (80, 443, {', '.join(map(str, R.SUSPICIOUS_PORTS))})"),
    (70, "R70", "structure", "10", "segments >= 8"),
    (71, "R71", "structure", "5", "segments BETWEEN 5 AND 7"),
    (72, "R72", "structure", "10", "nparams >= 10"),
    (73, "R73", "structure", "5", "nparams BETWEEN 6 AND 9"),
    (74, "R74", "structure", "8", "length(query) > 500"),
    (80, "R80", "payload", "15", f"last IN ({_list(R.DANGEROUS_EXTENSIONS)})"),
    (81, "R81", "payload", "10", f"last IN ({_list(R.ARCHIVE_EXTENSIONS)})"),
    (82, "R82", "payload", "15", f"before IN ({_list(R.DOCUMENT_EXTENSIONS)}) AND last IN ({_list(R.DANGEROUS_EXTENSIONS + R.ARCHIVE_EXTENSIONS)})"),
    (99, "AL", "info", "0", "allowlisted"),
]
_HITS = "  hits AS (" + "\n    UNION ALL ".join(f"SELECT result_id, {i} AS seq, '{rule}' AS rule_id, '{category}' AS category, {points} AS points FROM f WHERE {when}" for i, rule, category, points, when in _RULES)
_HITS += f"""
    UNION ALL SELECT result_id, 90 + place, arm, 'brand', points FROM top WHERE place <= 2
    UNION ALL SELECT result_id, 93, 'BR-combo', 'brand', 10 FROM top JOIN f USING (result_id) WHERE place = 1 AND points >= 20 AND sh + sp > 0
    UNION ALL SELECT result_id, 0, CASE WHEN special IS NULL THEN 'T4' WHEN special IN ({_list(R.DANGEROUS_SCHEMES)}) THEN 'T1' ELSE 'T2' END,
        CASE WHEN special IS NULL OR special IN ({_list(R.DANGEROUS_SCHEMES)}) THEN 'deception' ELSE 'info' END,
        CASE WHEN special IS NULL OR special IN ({_list(R.DANGEROUS_SCHEMES)}) THEN 100 ELSE 0 END FROM p1 WHERE special IS NOT NULL OR host = '')"""
_CAP = f"CASE category {' '.join(f"WHEN '{k}' THEN {v}" for k, v in R.CATEGORY_CAPS.items())} END"

SQL = {
    "rule_hits": f"WITH {_PARSED}, {_FACTS}, {_HITS} SELECT result_id, rule_id, category, points::INTEGER AS points FROM p1 LEFT JOIN hits USING (result_id)",
    "rule_scores": f"""WITH {_PARSED}, {_FACTS}, {_HITS},
      sums AS (SELECT result_id, category, min(seq) AS seq, least(sum(points), {_CAP})::DOUBLE AS p FROM hits WHERE points > 0 GROUP BY result_id, category),
      scaled AS (SELECT result_id, seq, CASE WHEN allowlisted AND category IN ({_list(R.SOFT_CATEGORIES)}) THEN p * 0.35::DOUBLE ELSE p END AS p FROM sums LEFT JOIN f USING (result_id)),
      total AS (SELECT result_id, least(round_even(list_reduce(list(p ORDER BY seq), lambda x, y: x + y), 0), 100)::INTEGER AS t FROM scaled GROUP BY result_id),
      ended AS (SELECT result_id, any_value(rule_id) AS t FROM hits WHERE rule_id IN ('T1', 'T2', 'T4') GROUP BY result_id),
      scored AS (SELECT p1.result_id, coalesce(f.allowlisted, false) AS allowlisted, ended.t AS e, CASE ended.t WHEN 'T1' THEN 100 WHEN 'T4' THEN 100 WHEN 'T2' THEN 0 ELSE coalesce(total.t, 0) END AS score
                 FROM p1 LEFT JOIN f USING (result_id) LEFT JOIN ended USING (result_id) LEFT JOIN total USING (result_id))
      SELECT result_id, allowlisted, score, CASE WHEN e = 'T2' THEN '{R.CLASS_NOT_WEB}' WHEN e = 'T4' THEN '{R.CLASS_INVALID}' WHEN score >= 60 THEN '{R.CLASS_HIGH}'
             WHEN score >= 30 THEN '{R.CLASS_MEDIUM}' ELSE '{R.CLASS_LOW}' END AS classification FROM scored""",
    "host_parts": f"""WITH {_PARSED}
      SELECT result_id, host <> '' AS valid, host, is_ip, CASE WHEN is_ip THEN concat_ws('.', ipn >> 24, (ipn >> 16) & 255, (ipn >> 8) & 255, ipn & 255) END AS ip, odd_ip AS obfuscated_ip, coalesce(private, false) AS ip_private,
             subdomain, sld, suffix, reg AS registered_domain, NOT is_ip AND suffix IN ({_list(R.FREE_HOSTING_SUFFIXES)}) AS free_hosting, port, port_text <> '' AND port IS NULL AS port_invalid, username
      FROM p1 JOIN hosts USING (host) WHERE special IS NULL""",
}


_CLEAR = "regexp_replace(regexp_replace({0}, '#$', ''), '\\?(#|$)', '\\1')"
_READABLE = "regexp_matches({0}, '" + _VISIBLE + "') AND NOT regexp_matches({0}, '" + _BEYOND_WALK + "')"
SQL["plain_walks"] = rf"""
    WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY obs_ts DESC NULLS LAST, obs_id DESC) AS rn FROM hop_obs WHERE url IS NOT NULL),
    hop AS (SELECT *, failure IS NULL AND status IS NOT NULL AS answered, lower(split_part(url, ':', 1)) AS scheme, regexp_extract(url, '^[^:]*:(//[^/?#]*)?', 1) AS place, trim(location) AS loc
            FROM o WHERE rn = 1 AND {_READABLE.format("url")} AND {_READABLE.format("coalesce(location, '')")}),
    led AS (SELECT *, CASE WHEN answered AND status IN (301, 302, 303, 307, 308) AND location <> '' THEN
              CASE WHEN loc = '' THEN url
                   WHEN regexp_matches(loc, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]') AND lower(split_part(loc, ':', 1)) = scheme THEN scheme || {_CLEAR.format("substr(loc, length(scheme) + 1)")}
                   WHEN regexp_matches(loc, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN loc
                   WHEN starts_with(loc, '//') THEN {_CLEAR.format("scheme || ':' || loc")}
                   WHEN starts_with(loc, '/') THEN {_CLEAR.format("scheme || ':' || place || loc")}
                   WHEN starts_with(loc, '?') THEN {_CLEAR.format("scheme || ':' || place || regexp_extract(substr(url, length(scheme) + 2 + length(place)), '^[^?#]*') || loc")}
                   WHEN starts_with(loc, '#') THEN {_CLEAR.format("split_part(url, '#', 1) || loc")}
                   ELSE {_CLEAR.format("scheme || ':' || place || coalesce(nullif(regexp_extract(substr(url, length(scheme) + 2 + length(place)), '^[^?#]*/'), ''), '/') || loc")} END END AS next FROM hop),
    starts AS (SELECT DISTINCT normalized_url AS u FROM results WHERE normalized_url <> '' AND {_READABLE.format("normalized_url")}),
    urls AS (SELECT u, lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme, lower(split_part(regexp_replace(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':', 1)) AS asked
             FROM (SELECT u FROM starts UNION SELECT next FROM led WHERE next IS NOT NULL)),
    named AS (SELECT rtrim(asked, '.') AS host FROM urls),
    {_HOSTS},
    a AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY obs_ts DESC NULLS LAST, obs_id DESC) AS rn FROM dns_obs WHERE host IS NOT NULL),
    dns AS (SELECT host AS asked, error IS NULL AND len(list_filter(coalesce(ips, []), lambda x: x IS NOT NULL)) > 0 AS found FROM a WHERE rn = 1),
    node AS (SELECT u, asked, status, next, answered, tls_error, cert_not_before,
                    CASE WHEN scheme NOT IN ('http', 'https') OR asked = '' THEN 'N10' WHEN NOT is_ip AND found IS NULL THEN 'N00' WHEN NOT is_ip AND NOT found THEN 'N11' WHEN NOT coalesce(answered, false) THEN 'N13' END AS stop
             FROM (SELECT urls.u, urls.scheme, urls.asked, is_ip, found, led.status, led.next, led.answered, led.tls_error, led.cert_not_before
                   FROM urls JOIN hosts ON hosts.host = rtrim(urls.asked, '.') LEFT JOIN dns ON dns.asked = urls.asked LEFT JOIN led ON led.url = urls.u)),
    w AS (SELECT u AS start, u AS current, [u] AS chain, 0 AS n, []::VARCHAR[] AS found, []::VARCHAR[] AS warned, false AS reached, true AS going, NULL::INTEGER AS status FROM starts
          UNION ALL
          SELECT start, CASE WHEN moves THEN next ELSE current END, CASE WHEN moves THEN list_append(chain, next) ELSE chain END, n + 1,
                 list_concat(found, list_filter([CASE WHEN stop = 'N10' OR stop = 'N13' THEN stop WHEN stop = 'N11' AND n > 0 THEN 'N11' WHEN stop = 'N00' AND n > 0 THEN 'N13' END,
                   CASE WHEN warns THEN 'N14' END, CASE WHEN stop IS NULL AND cert_not_before IS NOT NULL AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(cert_not_before) < 8 * 86400000000 THEN 'N15' END,
                   CASE WHEN leads AND n >= 5 THEN 'N16' END, CASE WHEN leads AND n < 5 AND loops THEN 'N17' END], lambda x: x IS NOT NULL)),
                 CASE WHEN warns THEN list_append(warned, asked) ELSE warned END, reached OR stop IS NULL, moves, CASE WHEN stop IS NULL AND NOT leads THEN here ELSE NULL END
          FROM (SELECT w.*, asked, stop, cert_not_before, next, node.status AS here, stop IS NULL AND next IS NOT NULL AS leads, coalesce(list_contains(chain, next), false) AS loops,
                       stop IS NULL AND next IS NOT NULL AND n < 5 AND NOT coalesce(list_contains(chain, next), false) AS moves, stop IS NULL AND coalesce(tls_error, '') <> '' AND NOT list_contains(warned, asked) AS warns
                FROM w JOIN node ON node.u = w.current WHERE going))
    SELECT start, array_to_string(chain, ' ') AS chain, reached, status, array_to_string(found, ' ') AS rules FROM w WHERE NOT going
"""
