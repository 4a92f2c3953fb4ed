"""The static rule catalogue: every rule is a (rule id, category, points, predicate) over parse columns.

texts() adds decoded and folded texts; static_indicators() turns the catalogue into one array column. All of it is
row-local. Points and categories are the contract; messages are ours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..config import Config
from ..functions.text import tokens
from ..functions.urls import ascii_registered_domain, below_any, looks_random

INDICATOR = "struct<seq: int, rule_id: string, category: string, points: int, message: string>"
_RAW = "array<struct<rule_id: string, category: string, points: int, message: string>>"

def _decoded(c: Column) -> Column:
    return F.when(c.contains("%"), F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))).otherwise(c)


#: Names that a plan holds as constants; a longer list (a ranked one can have a million) is a table that is joined.
MOST_CONSTANTS = 1000


def listed(df: DataFrame, column: str, names: Iterable[str], out: str) -> DataFrame:
    """df with `out`: whether df[column] is one of names; null stays null. A long list is joined, and broadcast if
    Spark finds it small enough."""
    names = sorted(names)
    if len(names) <= MOST_CONSTANTS:
        return df.withColumn(out, F.col(column).isin(*names))
    known = df.sparkSession.createDataFrame([(n,) for n in names], "__name string").withColumn("__in", F.lit(True))
    joined = df.join(known, F.col(column) == F.col("__name"), "left").withColumn(out, F.when(F.col(column).isNotNull(), F.coalesce("__in", F.lit(False))))
    return joined.drop("__name", "__in")


def texts(df: DataFrame, config: Config) -> DataFrame:
    """df, which parse() made with texts, and path_text, query_text (folded, decoded), file_text, embedded, user_text,
    host_tokens, host_compact, path_tokens, params array<struct<key, domain>>, user_content, allowlisted, texts_failed."""
    path, query = _decoded(F.col("path")), _decoded(F.col("query"))
    plain = {"path_text": path, "query_text": query, "file_text": path, "embedded": _decoded(F.concat("path", F.lit("?"), "query", F.lit("#"), "fragment")), "user_text": _decoded(F.col("username"))}
    s = df.withColumns({n: F.when(F.col("hard_texts"), F.coalesce(F.col(f"decoded.{n}"), F.lower(c))).otherwise(F.lower(c)) for n, c in plain.items()})
    pairs = F.filter(F.split("query", "&"), lambda x: x != "")

    def pair(kv: Column) -> Column:
        value = F.try_url_decode(F.when(kv.contains("="), F.regexp_replace(kv, "(?s)^[^=]*=", "")).otherwise(""))
        host = F.lower(F.regexp_replace(F.regexp_extract(value, r"(?s)^(?:https?:)?//([^/?#]*)", 1), "(?s)^.*@", ""))
        return F.struct(F.lower(F.try_url_decode(F.substring_index(kv, "=", 1))).alias("key"), F.regexp_replace(F.substring_index(host, ":", 1), r"\.+$", "").alias("host"))

    def facts(p: Column) -> Column:
        # only where a redirect parameter leads to is ever asked; p is a variable, so nothing in it is evaluated per use
        return F.struct(p["key"].alias("key"), F.when((p["host"] != "") & p["key"].isin(R.REDIRECT_PARAMS), ascii_registered_domain(p["host"])).alias("domain"))

    easy = F.transform(F.transform(F.when(~F.col("hard_texts"), pairs), pair), facts)
    given = F.zip_with("decoded.keys", "decoded.domains", lambda k, d: F.struct(k.alias("key"), d.alias("domain")))
    s = s.withColumns(
        {
            "params": F.coalesce(F.when(F.col("hard_texts"), given).otherwise(easy), F.array().cast("array<struct<key: string, domain: string>>")),
            "host_tokens": F.array_distinct(tokens(F.col("fold_host"))),
            "host_compact": F.regexp_replace("fold_host", "[^a-z0-9]", ""),
            "path_tokens": F.array_union(tokens(F.col("path_text")), tokens(F.col("query_text"))),
            "texts_failed": F.coalesce("decoded.failed", F.lit(False)),
            "user_content": below_any(F.col("host"), R.USER_CONTENT_HOSTS),
        }
    )
    s = listed(s, "registered_domain", config.allowlist, "__listed")
    trusted = ~F.col("is_ip") & ~F.col("free_hosting") & ~F.col("user_content") & F.col("__listed")
    return s.withColumn("allowlisted", trusted).drop("hard_texts", "decoded", "__listed")


def _hits(words: list[str], toks: Column, compact: Column | None = None) -> Column:
    found = F.array_intersect(F.array(*map(F.lit, words)), toks)
    if compact is None:
        return found
    long = F.array(*[F.lit(w) for w in words if len(w) >= 6]).cast("array<string>")
    return F.array_union(found, F.filter(long, lambda w: F.contains(compact, w)))


def keywords(df: DataFrame, config: Config) -> DataFrame:
    """Adds strong_h, weak_h, strong_p, weak_p and strong_hits (sorted): words found in host and path."""
    strong, weak = sorted(config.keywords_strong), sorted(config.keywords_weak)
    none = F.array().cast("array<string>")
    host = lambda words: F.when(F.col("is_ip"), none).otherwise(_hits(words, F.col("host_tokens"), F.col("host_compact")))
    s = df.withColumns({"strong_h": host(strong), "weak_h": host(weak), "strong_p": _hits(strong, F.col("path_tokens")), "weak_p": _hits(weak, F.col("path_tokens"))})
    return s.withColumns({"weak_h": F.array_except("weak_h", "strong_h"), "weak_p": F.array_except("weak_p", "strong_p"), "strong_hits": F.array_sort(F.array_union("strong_h", "strong_p"))})


@dataclass(frozen=True)
class Rule:
    """One indicator: emitted with `points` where `when` holds. Rules of one list are in emission order."""

    rule_id: str
    category: str
    points: int | Callable[[], Column]
    when: Callable[[], Column]
    message: Callable[[], Column]

    def column(self) -> Column:
        points = F.lit(self.points) if isinstance(self.points, int) else self.points()
        body = F.struct(F.lit(self.rule_id).alias("rule_id"), F.lit(self.category).alias("category"), points.cast("int").alias("points"), self.message().cast("string").alias("message"))
        return F.when(self.when(), body)


def _text(template: str, *columns: str) -> Callable[[], Column]:
    return lambda: F.format_string(template, *[F.col(c) for c in columns]) if columns else F.lit(template)


def _ladder(column: Callable[[], Column], steps: list[tuple[str, int, int]], category: str, message: str) -> list[Rule]:
    """(rule, at least, points), largest first; the first that is reached counts."""
    made, above = [], None
    for rule_id, least, points in steps:
        made.append(Rule(rule_id, category, points, lambda least=least, above=above: (column() >= least) & (F.lit(True) if above is None else column() < above), _text(message)))
        above = least
    return made


def catalogue(config: Config) -> dict[str, list[Rule]]:
    """All static rules but R16 and the brand rules, by group, in emission order."""
    c = F.col
    web = lambda: c("scheme").isin("http", "https")
    at = lambda: c("netloc").contains("@") & web()
    brands = F.array(*map(F.lit, config.brands))
    idn = lambda: c("host").rlike(r"(^|\.)xn--|[^\x00-\x7f]")
    name = lambda: ~c("is_ip")
    failed = lambda: c("x_failed")
    last, before = lambda: c("x_last"), lambda: c("x_before")
    port = lambda: F.when(~c("port_invalid") & (c("port") > 0), c("port"))
    tld = lambda: F.substring_index("suffix", ".", -1)
    return {
        "defanged": [Rule("I1", "info", 0, lambda: c("defanged"), _text("input was defanged"))],
        "scheme": [
            Rule("R00", "info", 0, lambda: ~c("explicit"), _text("no scheme given")),
            Rule("R01", "transport", 10, lambda: c("explicit") & (c("scheme") == "http"), _text("plain transport")),
            Rule("R02", "transport", 15, lambda: c("explicit") & ~web(), _text("not a web scheme: %s", "scheme")),
        ],
        "length": _ladder(lambda: F.length("normalized"), [("R03", 201, 15), ("R04", 151, 10), ("R05", 101, 5)], "structure", "long URL"),
        "deception": [
            Rule("R10", "deception", 25, at, _text("login part before the host %s", "host")),
            Rule("R11", "deception", 25, lambda: at() & (c("user_text").rlike(r"[a-z0-9-]+\.[a-z]{2,}") | F.arrays_overlap(tokens(c("user_text")), brands)), _text("login part imitates a name")),
            Rule("R12", "deception", 25, lambda: c("is_ip"), _text("address instead of a name")),
            Rule("R13", "deception", 20, lambda: c("is_ip") & c("obfuscated_ip"), _text("address in disguise: %s", "ip")),
            Rule("R14", "info", 0, lambda: c("is_ip") & ~c("obfuscated_ip") & c("ip_private"), _text("address is not public")),
            Rule("R15", "deception", 8, idn, _text("international name %s", "host_uni")),
        ],
        "deception_2": [
            Rule("R17", "deception", 30, lambda: c("mixed_label").isNotNull(), _text("mixed alphabets in label %s", "mixed_label")),
            Rule("R18", "deception", 20, lambda: c("cleaned").rlike(r"[\p{Cc}\p{Cf}]"), _text("invisible characters")),
            Rule("R19", "deception", 10, lambda: c("cleaned").contains("\\"), _text("backslash")),
            Rule("R20", "deception", 10, lambda: name() & c("host").rlike(r"[^a-z0-9._\-]"), _text("odd characters in the host")),
            Rule("R21", "structure", 10, lambda: name() & ~c("host").contains("."), _text("host without a suffix")),
        ],
        "host": [
            *_ladder(lambda: c("x_depth"), [("R22", 4, 15), ("R23", 3, 10), ("R24", 2, 3)], "structure", "labels before the name"),
            *_ladder(lambda: c("x_hyphens"), [("R25", 5, 12), ("R26", 3, 8)], "structure", "hyphens in the host"),
            Rule("R27", "structure", 10, lambda: name() & (c("uni_digits") >= 6), _text("digits in the host")),
            Rule("R28", "structure", 8, lambda: name() & c("host_uni").rlike("[._-]{3,}"), _text("separators in a row")),
            Rule("R29", "structure", 10, lambda: name() & c("x_random"), _text("random-looking label %s", "sld_uni")),
        ],
        "lexical": [
            Rule("R30", "lexical", lambda: c("x_host_points"), lambda: ~failed() & (c("x_host_points") > 0), lambda: F.concat(F.lit("words in the host: "), F.array_join(F.array_sort(F.array_union("strong_h", "weak_h")), ", "))),
            Rule("R31", "lexical", lambda: c("x_path_points"), lambda: ~failed() & (c("x_path_points") > 0), lambda: F.concat(F.lit("words in the path: "), F.array_join(F.array_sort(F.array_union("strong_p", "weak_p")), ", "))),
            Rule("R32", "lexical", 15, lambda: ~failed() & c("embedded").rlike("https?://"), _text("URL inside the URL")),
            Rule("R33", "lexical", 10, lambda: ~failed() & (F.size("x_redirecting") > 0), lambda: F.concat(F.lit("redirect parameters: "), F.array_join(F.array_sort(F.array_distinct(F.transform("x_redirecting", lambda p: p["key"]))), ", "))),
            Rule("R34", "lexical", 10, lambda: ~failed() & c("x_target").isNotNull(), lambda: F.concat(F.lit("parameter leads to "), c("x_target"))),
            Rule("I2", "info", 0, failed, _text("words could not be checked")),
        ],
        "hosting": [
            Rule("R40", "hosting", 20, lambda: name() & (c("host").isin(*config.shorteners) | c("registered_domain").isin(*config.shorteners)), _text("short link service")),
            Rule("R41", "hosting", 8, lambda: name() & c("free_hosting"), _text("free hosting under %s", "suffix")),
            Rule("R42", "hosting", 5, lambda: name() & c("user_content"), _text("shared page space")),
            Rule("R43", "hosting", 12, lambda: name() & tld().isin(*config.suspicious_tlds), _text("cheap ending of %s", "suffix")),
        ],
        "encoding": [
            Rule("R50", "structure", 15, lambda: F.regexp_replace("netloc", "(?s)^.*@", "").contains("%"), _text("escapes in the host")),
            Rule("R51", "structure", 8, lambda: c("path").rlike("%25|(?i)%(?:3[0-9]|4[1-9a-f]|5[0-9a]|6[1-9a-f]|7[0-9a])|(?i)%2e%2e|%2f%2f|%5c"), _text("needless escapes in the path")),
            Rule("R52", "structure", 8, lambda: c("path").contains("//"), _text("double slash in the path")),
        ],
        "ports": [
            Rule("R60", "transport", 10, lambda: c("port_invalid"), _text("port is no number")),
            Rule("R61", "transport", 8, lambda: port().isin(*config.suspicious_ports), _text("unusual port %d", "port")),
            Rule("R62", "transport", 4, lambda: ~port().isin(*config.suspicious_ports, 80, 443), _text("port %d", "port")),
        ],
        "path": [
            *_ladder(lambda: c("x_segments"), [("R70", 8, 10), ("R71", 5, 5)], "structure", "deep path"),
            *_ladder(lambda: c("x_params"), [("R72", 10, 10), ("R73", 6, 5)], "structure", "many parameters"),
            Rule("R74", "structure", 8, lambda: F.length("query") > 500, _text("long query")),
        ],
        "payload": [
            Rule("R80", "payload", 15, lambda: last().isin(R.DANGEROUS_EXTENSIONS), lambda: F.concat(F.lit("leads to a program: "), last())),
            Rule("R81", "payload", 10, lambda: last().isin(R.ARCHIVE_EXTENSIONS), lambda: F.concat(F.lit("leads to an archive: "), last())),
            Rule("R82", "payload", 15, lambda: before().isin(R.DOCUMENT_EXTENSIONS) & last().isin(R.DANGEROUS_EXTENSIONS + R.ARCHIVE_EXTENSIONS), lambda: F.concat(F.lit("file type in disguise: "), before(), F.lit("."), last())),
        ],
    }


#: Fixed value: points of each undecodable punycode label.
BAD_LABEL_POINTS = 12


def group_column(rules: list[Rule]) -> Column:
    return F.filter(F.array(*[r.column() for r in rules]), lambda x: x.isNotNull())


def static_groups(df: DataFrame, config: Config, groups: list[str] | None = None) -> DataFrame:
    """Adds one array column g_<group> per rule group (R16 among those of deception)."""
    file_name = F.substring_index("file_text", "/", -1)
    redirecting = F.filter("params", lambda p: p["key"].isin(R.REDIRECT_PARAMS))
    # what several rules use is a column of its own, so that the plan holds it once
    s = df.withColumns(
        {
            "x_random": looks_random(F.col("sld_uni")),
            "x_host_points": F.least(6 * F.size("strong_h") + 3 * F.size("weak_h"), F.lit(20)),
            "x_path_points": F.least(3 * F.size("strong_p") + F.size("weak_p"), F.lit(8)),
            "x_redirecting": redirecting,
            "x_segments": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
            "x_params": F.size(F.filter(F.split("query", "[&;]"), lambda x: x != "")),
            "x_exts": F.when(file_name.contains("."), F.slice(F.split(file_name, r"\."), 2, 1 << 20)),
            "x_depth": F.when(~F.col("is_ip"), F.size(F.filter(F.split("subdomain", r"\."), lambda x: x != ""))),
            "x_hyphens": F.when(~F.col("is_ip"), F.length(F.regexp_replace("host_uni", "[^-]", ""))),
        }
    )
    off_site = F.get(F.filter("x_redirecting", lambda p: p["domain"].isNotNull() & (p["domain"] != F.col("registered_domain"))), 0)["domain"]
    s = s.withColumns({"x_target": off_site, "x_last": F.try_element_at("x_exts", F.lit(-1)), "x_before": F.when(F.size("x_exts") >= 2, F.try_element_at("x_exts", F.lit(-2)))})
    s = s.withColumn("x_failed", F.coalesce(F.col("x_target") == "!", F.lit(False)) | F.col("texts_failed"))
    made = {}
    for group, rules in catalogue(config).items():
        if groups is None or group in groups:
            made[f"g_{group}"] = group_column(rules).cast(_RAW)
    if "g_deception" in made:
        bad = F.transform("bad_labels", lambda b: F.struct(F.lit("R16").alias("rule_id"), F.lit("deception").alias("category"), F.lit(BAD_LABEL_POINTS).alias("points"), F.concat(F.lit("label can't be decoded: "), b).alias("message")))
        made["g_deception"] = F.concat(made["g_deception"], F.when(~F.col("is_ip"), bad.cast(_RAW)).otherwise(F.array().cast(_RAW)), made.pop("g_deception_2", F.array().cast(_RAW)))
    return s.withColumns(made).drop(*[c for c in s.columns if c.startswith("x_")])


def numbered(raw: Column) -> Column:
    """Indicators with their emission order."""
    return F.transform(raw, lambda x, i: F.struct(i.cast("int").alias("seq"), x["rule_id"].alias("rule_id"), x["category"].alias("category"), x["points"].alias("points"), x["message"].alias("message")))
