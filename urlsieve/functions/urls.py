"""URL and host parsing as staged projections: plain ASCII in Catalyst, unusual hosts through one Arrow UDF.

Every stage is a select whose columns the next stage names, so no expression is evaluated once per use. parse() is
row-local: it works on static and streaming frames alike and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from .hosts import netloc_facts, text_facts
from .text import SPACE, entropy, refang, strip

#: Escapes that Catalyst's decoder doesn't treat as the rules want: malformed, non-ASCII, or escaped percent signs.
_HARD = r"[^\x00-\x7f]|%(?![0-7][0-9a-fA-F])|%25"

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
#: Schemes whose last path segment can carry ';parameters', as the standard URL splitter has them.
PARAM_SCHEMES = "ftp hdl prospero http https shttp rtsp rtsps sip sips mms sftp tel".split()
#: IPv4 networks that are not globally routable (first address, prefix length).
PRIVATE_V4 = (
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("100.64.0.0", 10),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 24),
    ("192.0.2.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("240.0.0.0", 4),
)
#: Routable addresses inside those networks.
PUBLIC_V4 = ("192.0.0.9", "192.0.0.10")


def special_scheme(cleaned: Column) -> Column:
    """URL-2: a scheme that has no host (lower case), or null. 'mailto://h' is an ordinary URL."""
    m = F.lower(F.regexp_extract(cleaned, _SCHEME, 1))
    slashed = cleaned.rlike(_SCHEME + "//")
    return F.when(m.isin(R.DANGEROUS_SCHEMES) | (~slashed & m.isin(R.NON_WEB_SCHEMES)), m)


def normalized(cleaned: Column) -> tuple[Column, Column]:
    """URL-3: (URL with a scheme, whether it had one)."""
    u = strip(cleaned)
    has = u.rlike(_SCHEME + "//")
    return F.when(has, u).otherwise(F.concat(F.lit("http://"), F.regexp_replace(u, "^//", ""))), has


# ---------------------------------------------------------------- hosts


def _ipv4_parts(h: Column) -> Column:
    """Numbers of a dotted legacy IPv4 host, null for one that isn't a number in its notation."""

    def number(p: Column) -> Column:
        hexed = p.startswith("0x")
        octal = p.rlike("^0[0-9]+$")
        digits = F.regexp_replace(F.when(hexed, F.substring(p, 3, 1 << 20)).otherwise(p), "^0+(?=.)", "")
        base = F.when(hexed, F.lit(16)).when(octal, F.lit(8)).otherwise(F.lit(10))
        fits = F.length(digits) <= F.when(hexed, 8).when(octal, 11).otherwise(10)
        right = F.when(octal, p.rlike("^[0-7]+$")).otherwise(F.lit(True))
        value = F.when(hexed, F.conv(digits, 16, 10)).when(octal, F.conv(digits, 8, 10)).otherwise(digits)
        return F.when(fits & right & base.isNotNull(), value.cast("bigint"))

    return F.transform(F.split(h, r"\."), number)


def ipv4_value(host: Column) -> Column:
    """URL-8 for IPv4: the address as a number, from one to four decimal, octal or hexadecimal parts; else null."""
    shape = host.rlike(r"^(?:0x[0-9a-f]+|[0-9]+)(?:\.(?:0x[0-9a-f]+|[0-9]+)){0,3}$")
    n = _ipv4_parts(host)
    size = F.size(n)
    last = F.element_at(n, -1)
    heads = F.slice(n, 1, F.greatest(size - 1, F.lit(0)))
    ok = F.forall(n, lambda x: x.isNotNull()) & F.forall(heads, lambda x: x < 256) & (last < F.call_function("shiftleft", F.lit(1).cast("bigint"), 8 * (5 - size)))
    value = last + F.aggregate(F.transform(heads, lambda x, i: F.call_function("shiftleft", x, 24 - 8 * i)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(shape, F.when(ok, value))


def ipv4_text(value: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(value, s).bitwiseAND(255)).cast("string") for s in (24, 16, 8, 0)])


def ipv4_strict(host: Column) -> Column:
    part = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return host.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return a << 24 | b << 16 | c << 8 | d


def ipv4_private(value: Column) -> Column:
    """Not globally routable."""
    inside = F.lit(False)
    for first, bits in PRIVATE_V4:
        lo = _number(first)
        inside = inside | value.between(lo, lo + (1 << (32 - bits)) - 1)
    return inside & ~value.isin([_number(x) for x in PUBLIC_V4])


def domain_parts(host: Column) -> Column:
    """URL-10: struct(subdomain, sld, suffix) of an ASCII host, by the known two-label suffixes, else the last label."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    k = F.when((n > 2) & two.isin(R.KNOWN_SUFFIXES), 2).otherwise(1)
    parted = F.struct(
        F.array_join(F.slice(labels, 1, F.greatest(n - k - 1, F.lit(0))), ".").alias("subdomain"),
        F.get(labels, n - k - 1).alias("sld"),
        F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".").alias("suffix"),
    )
    return F.when(n < 2, F.struct(F.lit("").alias("subdomain"), host.alias("sld"), F.lit("").alias("suffix"))).otherwise(parted)


def registered(parts: Column) -> Column:
    return F.when(parts["suffix"] != "", F.concat_ws(".", parts["sld"], parts["suffix"])).otherwise(parts["sld"])


def ascii_registered_domain(host: Column) -> Column:
    """Registered domain of a lower-case ASCII host; an IPv4 host is its own."""
    return F.when(ipv4_value(host).isNotNull(), host).otherwise(registered(domain_parts(host)))


def host_suffixes(host: Column) -> Column:
    """The host and all its parents, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))


def below_any(host: Column, domains: list[str]) -> Column:
    """Whether the host equals or lies below one of the domains: a look-up of its suffixes, not a scan of the list."""
    return F.arrays_overlap(host_suffixes(host), F.array(*map(F.lit, sorted(domains))))


def looks_random(label: Column) -> Column:
    """TXT-9: whether a host label looks generated. The entropy is computed for the few labels that pass the rest."""
    s = F.replace(label, F.lit("-"), F.lit(""))
    letters = F.length(F.regexp_replace(s, "[^a-zA-Z]", ""))
    vowels = F.length(F.regexp_replace(s, "[^aeiou]", ""))
    mixed = s.rlike(r"[a-z][0-9]+[a-z]") & (F.length(F.regexp_replace(s, "[^0-9]", "")) >= 2)
    hard = (letters == 0) | (vowels / F.greatest(letters, F.lit(1)) <= 0.2) | mixed
    return F.when((F.length(s) >= 10) & s.rlike(r"^[\x00-\x7f]*$") & hard, entropy(s) >= 3.2).otherwise(F.lit(False))


# ---------------------------------------------------------------- the parse stage


def split_url(df: DataFrame, url: str, keep: list[str]) -> DataFrame:
    """keep + scheme, netloc, path, params, query, fragment of a URL with a scheme (URL-4); '' for what is missing.

    TAB, CR and LF inside the URL are dropped first; ';params' of the last segment leave the path.
    """
    u = F.regexp_replace(url, r"[\t\r\n]", "")
    pattern = r"(?s)^([a-zA-Z][a-zA-Z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    s = df.select(*keep, u.alias("__u"))
    s = s.select(*keep, F.lower(F.regexp_extract("__u", pattern, 1)).alias("scheme"), *[F.regexp_extract("__u", pattern, i).alias(n) for i, n in ((2, "netloc"), (3, "__p"), (4, "query"), (5, "fragment"))])
    with_params = F.col("scheme").isin(PARAM_SCHEMES)
    last = r"(?s)^(.*/[^/;]*|[^/;]*);([^/]*)$"
    has = with_params & F.col("__p").rlike(last)
    path = F.when(has, F.regexp_extract("__p", last, 1)).otherwise(F.col("__p"))
    params = F.when(has, F.regexp_extract("__p", last, 2)).otherwise("")
    return s.select(*keep, "scheme", "netloc", path.alias("path"), params.alias("params"), "query", "fragment")


def parse(df: DataFrame, url: str = "url", texts: bool = False) -> DataFrame:
    """df with one row's parse columns added (the df must not have columns of these names):

    given, cleaned, defanged, special, normalized, explicit, scheme, netloc, path, query, fragment, username, port,
    port_invalid, valid, broken, crashed, host, host_uni, is_ip, ip, obfuscated_ip, ip_private, subdomain, sld, suffix, sub_uni,
    sld_uni, registered_domain, free_hosting, mixed_label, bad_labels, uni_digits.
    With texts also fold_host, fold_sub, fold_sld (folded as TXT-6 has it), and where Catalyst can't decode the rest
    (hard_texts) the struct `decoded` of hosts.TEXTS. Both Python functions see columns of one stage: were one to see
    what another made, all expressions between them would be put into one and evaluated once per use.
    A null URL is treated as ''. `valid` is false where the URL can't be split (`broken`) or has no host.
    """
    keep = df.columns
    text = F.coalesce(F.col(url), F.lit(""))
    s = df.select(*keep, strip(text).alias("given"), refang(text).alias("cleaned"))
    norm, explicit = normalized(F.col("cleaned"))
    s = s.select(*keep, "given", "cleaned", (F.col("cleaned") != F.col("given")).alias("defanged"), special_scheme(F.col("cleaned")).alias("special"), norm.alias("normalized"), explicit.alias("explicit"))
    keep += ["given", "cleaned", "defanged", "special", "normalized", "explicit"]
    s = split_url(s, "normalized", keep)
    keep += ["scheme", "netloc", "path", "query", "fragment"]
    info = F.regexp_extract("netloc", "(?s)^(.*)@", 1)
    bare = F.regexp_replace("netloc", "(?s)^.*@", "")
    odd = ~F.col("netloc").rlike(r"^[\x00-\x7f]*$") | F.col("netloc").rlike(r"[\[\]%]|(?i)xn--") | bare.rlike(":.*:")
    s = s.select(*keep, F.substring_index(info, ":", 1).alias("username"), bare.alias("__bare"), odd.alias("__odd"))
    made = {"__f": netloc_facts(F.when(F.col("__odd"), F.col("netloc")))}
    if texts:
        hard = F.concat_ws(" ", "username", "path", "query", "fragment").rlike(_HARD) | F.col("query").rlike(r"[\[\]]|%5[bBdD]")
        s = s.withColumn("hard_texts", hard)
        made["decoded"] = text_facts(F.when(F.col("hard_texts"), F.array("path", "query", "fragment", "username")))
        keep += ["hard_texts", "decoded"]
    s = s.withColumns(made)
    plain = F.rtrim(F.lower(F.substring_index("__bare", ":", 1)), F.lit("."))
    port_text = F.when(F.col("__bare").contains("["), F.regexp_extract("__bare", r"\][^:]*:(.*)$", 1)).otherwise(F.regexp_extract("__bare", "(?s)^[^:]*:(.*)$", 1))
    s = s.withColumns({"__host": F.when(F.col("__odd"), F.coalesce("__f.ascii", F.lit(""))).otherwise(plain), "__port": port_text})
    number = F.when(F.col("__port").rlike("^[0-9]+$"), F.regexp_replace("__port", "^0+(?=.)", ""))
    number = F.when(F.length(number) <= 5, number.cast("int"))
    s = s.withColumns({"__v4": F.when(~F.col("__odd"), ipv4_value(F.col("__host"))), "__n": number, "__valid": F.coalesce("__f.valid", F.lit(True)) & (F.col("__host") != "")})
    v4 = F.col("__v4").isNotNull()
    is_ip = F.when(F.col("__odd"), F.col("__f.ip").isNotNull()).otherwise(v4)
    s = s.withColumns(
        {
            "__ip": is_ip & F.col("__valid"),
            "__uni": F.when(F.col("__odd"), F.col("__f.uni")).otherwise(F.col("__host")),
            "__d": domain_parts(F.col("__host")),
        }
    )
    ok, ip, none = F.col("__valid"), F.col("__ip"), F.lit("")
    labels = F.split("__uni", r"\.")
    below = F.when(F.col("__d.subdomain") == "", 0).otherwise(F.size(F.split("__d.subdomain", r"\.")))
    named = lambda c: F.when(ip, none).otherwise(c)
    folded = F.when(F.col("__odd"), F.col("__f.folded")).otherwise(labels)
    folds = {"fold_host": F.when(ok, F.array_join(folded, ".")).otherwise(""), "fold_sub": named(F.array_join(F.slice(folded, 1, below), ".")), "fold_sld": named(F.coalesce(F.get(folded, below), F.lit("")))}
    return s.select(
        *keep,
        *[c.alias(n) for n, c in folds.items() if texts],
        "username",
        F.when((F.col("__n") <= 65535), F.col("__n")).alias("port"),
        ((F.col("__port") != "") & F.coalesce(F.col("__n") > 65535, F.lit(True))).alias("port_invalid"),
        ok.alias("valid"),
        (~F.coalesce("__f.valid", F.lit(True))).alias("broken"),
        F.coalesce("__f.crashed", F.lit(False)).alias("crashed"),
        F.when(ok, F.col("__host")).otherwise("").alias("host"),
        F.when(ok, F.col("__uni")).otherwise("").alias("host_uni"),
        ip.alias("is_ip"),
        F.when(ip, F.when(F.col("__odd"), F.col("__f.ip")).otherwise(ipv4_text(F.col("__v4")))).alias("ip"),
        (ip & F.when(F.col("__odd"), F.coalesce("__f.obfuscated", F.lit(False))).otherwise(~ipv4_strict(F.col("__host")))).alias("obfuscated_ip"),
        (ip & F.when(F.col("__odd"), F.coalesce("__f.ip_private", F.lit(False))).otherwise(F.coalesce(ipv4_private(F.col("__v4")), F.lit(False)))).alias("ip_private"),
        named(F.col("__d.subdomain")).alias("subdomain"),
        named(F.col("__d.sld")).alias("sld"),
        named(F.col("__d.suffix")).alias("suffix"),
        named(F.array_join(F.slice(labels, 1, below), ".")).alias("sub_uni"),
        named(F.coalesce(F.get(labels, below), F.lit(""))).alias("sld_uni"),
        F.when(~ok, "").when(ip, F.col("__host")).otherwise(registered(F.col("__d"))).alias("registered_domain"),
        (~ip & F.col("__d.suffix").isin(R.FREE_HOSTING_SUFFIXES)).alias("free_hosting"),
        F.col("__f.mixed").alias("mixed_label"),
        F.coalesce("__f.bad_labels", F.array().cast("array<string>")).alias("bad_labels"),
        F.coalesce("__f.digits", F.length(F.regexp_replace("__host", "[^0-9]", ""))).alias("uni_digits"),
    )


def canonical_key(url: Column) -> Column:
    """URL-14: key under which block-listed URLs match, whatever their scheme, letter case or trailing slashes."""
    return F.rtrim(F.lower(F.regexp_replace(strip(refang(url)), "(?i)^[a-z][a-z0-9+.-]*://", "")), F.lit("/"))


def parse_host(df: DataFrame, hostname: str) -> DataFrame:
    """URL-11 over a column of host names: df with the host columns of parse()."""
    wrapped = df.withColumn("__h", F.concat(F.lit("http://"), F.coalesce(F.col(hostname), F.lit("")), F.lit("/")))
    return parse(wrapped, "__h").drop("__h")


__all__ = ["SPACE", "parse", "parse_host", "split_url", "canonical_key", "host_suffixes", "below_any", "looks_random"]
