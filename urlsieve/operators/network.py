"""Rules over recorded observations: DNS, redirect walks, TLS, destinations, page content, domain age, threat reports.

Fetching is not part of scoring: a provider writes observation tables, these operators join them. Everything is worked
out once per distinct URL, host or domain and joined back by key. The redirect walk is a loop of at most
max_redirects + 1 rounds over the URLs still under way; each round's state is written to the checkpoint folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..config import Config, Options
from ..functions.hosts import event_times, ips_global, ips_reachable, join_url, parse_page, url_host
from ..functions.text import tokens
from ..functions.urls import ascii_registered_domain, below_any, domain_parts, ipv4_value, registered
from ..runtime import cut
from ..sources.observations import observation
from .rules import listed
from .skew import lookup_join

RAW = "array<struct<rule_id: string, category: string, points: int, message: string>>"
#: Statuses that redirect; days that make a certificate or a domain young.
REDIRECTS = [301, 302, 303, 307, 308]
YOUNG_CERTIFICATE = 7
AGES = [("N30", 30, 25), ("N31", 90, 15), ("N32", 180, 8)]
MANY_ADDRESSES = 8
LONG_CHAIN = 3


def rule(rule_id: str, category: str, points: int | Column, message: str | Column, when: Column | None = None) -> Column:
    p = F.lit(points) if isinstance(points, int) else points
    m = F.lit(message) if isinstance(message, str) else message
    body = F.struct(F.lit(rule_id).alias("rule_id"), F.lit(category).alias("category"), p.cast("int").alias("points"), m.alias("message"))
    return body if when is None else F.when(when, body)


def rules(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull()).cast(RAW)


def none() -> Column:
    return F.array().cast(RAW)


def hosted(df: DataFrame, url: str) -> DataFrame:
    """df with h_scheme, h_host (ASCII), h_domain, h_ip of a URL; nulls where it is malformed."""
    odd = F.col(url).rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(?:[\[\]%]|[^\x00-\x7f]|(?i)xn--)")
    parts = r"(?s)^([a-zA-Z][a-zA-Z0-9+.\-]*):(?://([^/?#]*))?"
    bare = F.regexp_replace(F.regexp_extract(F.regexp_replace(url, r"[\t\r\n]", ""), parts, 2), "(?s)^.*@", "")
    s = df.withColumns({"__odd": odd, "__u": url_host(F.when(odd, F.col(url))), "__h": F.lower(F.substring_index(bare, ":", 1)), "__s": F.lower(F.regexp_extract(url, parts, 1))})
    plain = F.regexp_replace("__h", r"\.+$", "")
    s = s.withColumns(
        {
            "h_scheme": F.when(F.col("__odd"), F.col("__u.scheme")).otherwise(F.col("__s")),
            "h_host": F.when(F.col("__odd"), F.col("__u.host")).otherwise(F.col("__h")),
            "h_domain": F.when(F.col("__odd"), F.col("__u.domain")).otherwise(ascii_registered_domain(plain)),
            "h_ip": F.when(F.col("__odd"), F.col("__u.is_ip")).otherwise(ipv4_value(plain).isNotNull()),
        }
    )
    return s.drop("__odd", "__u", "__h", "__s")


def dns_rules(ips: Column, error: Column, all_global: Column, is_ip: Column, observed: Column | None = None) -> Column:
    """N01 to N03. A host without an observation was not looked up: that is told (N00) and costs no points."""
    looked = F.lit(True) if observed is None else (is_ip | observed)
    failed = looked & (error.isNotNull() | (F.coalesce(F.size(ips), F.lit(0)) == 0))
    return rules(
        rule("N00", "info", 0, "host was not looked up", ~looked),
        rule("N01", "dns", 8, F.coalesce(error, F.lit("host was not resolved")), failed),
        rule("N02", "dns", 10, "name resolves to an address that isn't public", looked & ~failed & ~is_ip & F.exists(all_global, lambda g: ~g)),
        rule("N03", "dns", 5, F.concat(F.size(ips).cast("string"), F.lit(" addresses")), looked & ~failed & (F.size(ips) > MANY_ADDRESSES)),
    )


def dns_table(observations: dict, spark) -> DataFrame:
    """host, ips (distinct, sorted), error, all_global and usable flags of each address."""
    dns = observation(observations, "dns_obs", spark)
    ips = F.array_sort(F.array_distinct(F.filter(F.coalesce("ips", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    return dns.select("host", ips.alias("ips"), "error").withColumns({"global": ips_global("ips"), "reachable": ips_reachable("ips")})


def nodes(starts: DataFrame, hops: DataFrame, dns: DataFrame, options: Options, now: Column) -> DataFrame:
    """What a walk meets at each URL it can come to, worked out once per URL: (current, h_host, web, addresses, stop,
    status, next, leads, distrusted, young). Hosts meet their addresses once per distinct host."""
    empty = F.array().cast("array<string>")
    answered = F.col("failure").isNull() & F.col("status").isNotNull()
    moves = answered & F.col("status").isin(REDIRECTS) & (F.coalesce("location", F.lit("")) != "")
    pages = hops.select(F.col("url").alias("current"), "status", "tls_error", "cert_not_before", answered.alias("answered"), join_url(F.col("url"), F.when(moves, F.col("location"))).alias("next"), moves.alias("moves"))
    pages = cut(pages)
    every = starts.select(F.col("start").alias("current")).unionAll(pages.filter("next.url is not null").select("next.url")).distinct()
    names = dns.select(F.col("host").alias("h_host"), F.col("ips").alias("d_ips"), "error", "reachable", F.lit(True).alias("looked"))
    s = lookup_join(cut(hosted(every, "current")), names, "h_host").join(pages, "current", "left")
    addresses = F.when(F.col("h_ip"), F.array("h_host")).when(F.col("error").isNull(), F.col("d_ips"))
    s = s.withColumn("addresses", F.coalesce(addresses, empty))
    s = s.withColumn("u_reach", F.coalesce(ips_reachable(F.when(F.col("h_ip"), F.col("addresses"))), F.col("reachable")))
    usable = F.lit(True) if options.allow_private else F.coalesce(F.exists("u_reach", lambda x: x), F.lit(False))
    web = F.coalesce(F.col("h_scheme").isin("http", "https") & (F.col("h_host") != ""), F.lit(False))
    stop = (
        F.when(~web, "N10")
        .when(~F.col("h_ip") & F.col("looked").isNull(), "N00")
        .when(F.size("addresses") == 0, "N11")
        .when(~usable, "N12")
        .when(~F.coalesce("answered", F.lit(False)), "N13")
    )
    s = s.withColumns({"web": web, "stop": stop})
    fetched = F.col("stop").isNull()
    age = F.greatest(F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("cert_not_before").cast("timestamp"))) / 86_400_000_000), F.lit(0))
    return cut(
        s.select(
            "current",
            "h_host",
            "web",
            "addresses",
            "stop",
            "status",
            "next",
            (fetched & F.coalesce("moves", F.lit(False))).alias("leads"),
            (fetched & (F.coalesce("tls_error", F.lit("")) != "")).alias("distrusted"),
            (fetched & F.col("cert_not_before").isNotNull() & (age <= YOUNG_CERTIFICATE)).alias("young"),
        )
    )


def walk(starts: DataFrame, hops: DataFrame, dns: DataFrame, options: Options, now: Column) -> DataFrame:
    """NET-7 over starts(start), distinct: (start, chain, reached, aborted, status, final_url, ips, found).

    found are the walk's indicators in order; a malformed Location aborts the walk and loses them. `status` is null
    where no response ended the walk. A host that was not looked up ends the walk like a failed request. Each round
    joins the URLs under way to nodes(); many walks may come to one URL.
    """
    met = nodes(starts, hops, dns, options, now)
    state = cut(
        starts.select("start", F.col("start").alias("current"), F.array("start").alias("chain"), F.lit(False).alias("reached"), none().alias("found"), F.array().cast("array<string>").alias("warned"), F.lit(None).cast("array<string>").alias("ips"))
    )
    ended: list[DataFrame] = []
    for redirects in range(options.max_redirects + 1):
        s = lookup_join(state, met, "current")
        moved = redirects > 0
        blocked = (
            F.when(F.col("stop") == "N10", rule("N10", "network" if moved else "info", 15 if moved else 0, "not a web address"))
            .when((F.col("stop") == "N11") & F.lit(moved), rule("N11", "network", 8, "target was not resolved"))
            .when(F.col("stop") == "N12", rule("N12", "network" if moved else "info", 20 if moved else 0, "address isn't public"))
            .when((F.col("stop") == "N13") | ((F.col("stop") == "N00") & F.lit(moved)), rule("N13", "info", 0, "request failed"))
        )
        warn = F.col("distrusted") & ~F.array_contains("warned", F.col("h_host"))
        too_many = redirects + 1 > options.max_redirects
        loop = F.array_contains("chain", F.col("next.url"))
        led = F.col("leads") & F.col("next.url").isNotNull()
        more = rules(
            blocked,
            rule("N14", "tls", 15, F.concat(F.lit("certificate not trusted: "), F.col("h_host")), warn),
            rule("N15", "tls", 8, "certificate is new", F.col("young")),
            rule("N16", "network", 10, "too many redirects", led & F.lit(too_many)),
            rule("N17", "network", 8, "redirect loop", led & F.lit(not too_many) & loop),
        )
        on = led & ~loop & F.lit(not too_many)
        fetched = F.col("stop").isNull()
        s = s.select(
            "start",
            F.when(on, F.col("next.url")).otherwise(F.col("current")).alias("current"),
            F.when(on, F.array_append("chain", F.col("next.url"))).otherwise(F.col("chain")).alias("chain"),
            (F.col("reached") | fetched).alias("reached"),
            F.concat("found", more).alias("found"),
            F.when(warn, F.array_append("warned", F.col("h_host"))).otherwise(F.col("warned")).alias("warned"),
            F.coalesce("ips", F.when(F.col("web"), F.col("addresses"))).alias("ips"),
            F.when(fetched & ~F.col("leads"), F.col("status")).alias("status"),
            (F.col("leads") & F.coalesce("next.failed", F.lit(False))).alias("aborted"),
            F.coalesce(on, F.lit(False)).alias("on"),
        )
        s = cut(s)
        ended.append(s.filter("not on").drop("on"))
        state = s.filter("on").drop("on", "status", "aborted")
        if state.isEmpty():
            break
    every = reduce(DataFrame.unionByName, ended)
    return every.select("start", "chain", "reached", "aborted", "status", F.element_at("chain", -1).alias("final_url"), "ips", "found")


def telling_forms(page: Column, final_domain: Column, final_scheme: Column) -> Column:
    """The forms of a page that show something; the first of them counts."""
    return F.filter(page["forms"], lambda f: (f["target_domain"] != final_domain) | ((f["password"] > 0) & (f["target_scheme"] == "http") & (final_scheme == "https")))


def content_rules(page: Column, final_domain: Column, final_scheme: Column, config: Config) -> Column:
    """C1 to C5 over a parse_page() struct. Only the first form that shows something counts."""
    form = F.get(telling_forms(page, final_domain, final_scheme), 0)
    elsewhere = form["target_domain"] != final_domain
    words = tokens(page["title_fold"])
    brands = F.array(*[F.struct(F.lit(b).alias("brand"), F.array(*map(F.lit, sorted(d))).alias("domains")) for b, d in config.brands.items() if len(b) >= 4])
    named = F.get(F.filter(brands, lambda b: F.array_contains(words, b["brand"]) & ~F.array_contains(b["domains"], final_domain)), 0)
    return rules(
        rule("C1", "content", 8, "password box", page["password_fields"] > 0),
        rule("C2", "content", F.when(form["password"] > 0, 30).otherwise(20), F.concat(F.lit("form leaves for "), form["target_domain"]), elsewhere),
        rule("C3", "content", 12, "password sent in plain", ~elsewhere),
        rule("C4", "content", 25, F.concat(F.lit("title names "), named["brand"]), named.isNotNull()),
        rule("C5", "info", 0, F.concat(F.lit("page refreshes to "), F.substring(page["meta_refresh"], 1, 80)), page["meta_refresh"].isNotNull() & (page["meta_refresh"] != "")),
    )


def domain_ages(rdap: DataFrame, now: Column) -> DataFrame:
    """TI-1: (domain, age, error): days since the first readable registration event, floored, at least 0."""
    dates = F.transform(F.filter(F.coalesce("events", F.array().cast("array<struct<eventAction: string, eventDate: string>>")), lambda e: (e["eventAction"] == "registration") & (F.coalesce(e["eventDate"], F.lit("")) != "")), lambda e: e["eventDate"])
    s = rdap.select("domain", "error", event_times(dates).alias("times"))
    first = F.get(F.filter("times", lambda t: t.isNotNull()), 0)
    days = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(first)) / 86_400_000_000)
    age = F.when(first.isNotNull(), F.greatest(days, F.lit(0))).cast("int")  # greatest() would pass over a null
    return s.select("domain", F.when(F.col("error").isNull(), age).alias("age"), F.coalesce("error", F.when(age.isNull(), F.lit("no registration date"))).alias("error"))


def age_rule(domain: Column, age: Column, error: Column) -> Column:
    """N30 to N33 for one domain."""
    made = F.when(error.isNotNull(), rule("N33", "info", 0, F.concat(domain, F.lit(": "), error)))
    for rule_id, days, points in AGES:
        made = made.when(age < days, rule(rule_id, "age", points, F.concat(domain, F.lit(" is "), age.cast("string"), F.lit(" days old"))))
    return made


def threat_rules(gsb: Column, vt: Column, options: Options) -> Column:
    """TI-2 and TI-3 for one URL: gsb struct(threat_types, error), vt struct(has_report, malicious, suspicious, error)."""
    types = F.array_sort(F.array_distinct(gsb["threat_types"]))
    mal, sus = F.coalesce(vt["malicious"], F.lit(0)), F.coalesce(vt["suspicious"], F.lit(0))
    seen = vt["error"].isNull() & F.coalesce(vt["has_report"], F.lit(False))
    g = [rule("GSB", "intel", 60, F.concat(F.lit("listed: "), F.array_join(types, ", ")), gsb["error"].isNull() & (F.size(types) > 0)), rule("GSB-E", "info", 0, "list look-up failed", gsb["error"].isNotNull())]
    v = [
        rule("VT-0", "info", 0, "no report", vt["error"].isNull() & ~F.coalesce(vt["has_report"], F.lit(False))),
        F.when(seen, F.when(mal >= 3, rule("VT-3", "intel", 55, "several engines warn")).when(mal >= 1, rule("VT-1", "intel", 30, "an engine warns")).when(sus >= 3, rule("VT-S", "intel", 15, "engines suspect"))),
        rule("VT-E", "info", 0, "report look-up failed", vt["error"].isNotNull()),
    ]
    return rules(*(g if options.gsb else []), *(v if options.vt else []))


def _own_name(host: Column) -> Column:
    """Whether a host's name can vouch for it: not rented below a free or shared suffix."""
    return ~domain_parts(host)["suffix"].isin(R.FREE_HOSTING_SUFFIXES) & ~below_any(host, R.USER_CONTENT_HOSTS)


def network_dim(urls: DataFrame, config: Config, options: Options, observations: dict, now: Column) -> DataFrame:
    """urls(normalized, explicit, host, is_ip, ip, registered_domain), distinct: the same keys with found (in order),
    resolved_ips, redirect_chain, final_url. `now` is the time that ages are measured against."""
    spark = urls.sparkSession
    dns = dns_table(observations, spark)
    base = cut(urls.distinct())
    s = base
    lookup = F.when(F.col("is_ip"), F.col("ip")).otherwise(F.col("host"))
    found: list[str] = []
    s = lookup_join(s.withColumn("lookup", lookup), dns.select(F.col("host").alias("lookup"), F.col("ips").alias("d_ips"), "error", F.col("global").alias("d_global"), F.lit(True).alias("looked")), "lookup")
    own = F.when(F.col("is_ip"), F.array("lookup")).when(F.col("error").isNull(), F.col("d_ips"))
    s = s.withColumn("resolved_ips", F.coalesce(own, F.array().cast("array<string>")))
    if options.dns or options.fetches:
        s = s.withColumn("n_dns", dns_rules(F.col("resolved_ips"), F.when(~F.col("is_ip"), F.col("error")), F.when(~F.col("is_ip"), F.col("d_global")), F.col("is_ip"), F.col("looked").isNotNull()))
        found.append("n_dns")
    else:
        s = s.withColumn("resolved_ips", F.array().cast("array<string>"))
    s = s.drop("lookup", "looked", "d_ips", "error", "d_global").withColumns({"final_url": F.col("normalized"), "redirect_chain": F.array().cast("array<string>"), "aborted": F.lit(False)})
    final_domain, hops_made = F.col("registered_domain"), F.lit(0)
    if options.fetches:
        hops = observation(observations, "hop_obs", spark)
        secure = F.regexp_replace("normalized", "^http://", "https://")
        starts = base.select(F.explode(F.when(F.col("explicit"), F.array("normalized")).otherwise(F.array(secure, "normalized"))).alias("start")).distinct()
        walks = cut(walk(starts, hops, dns, options, now))
        pick = lambda name: walks.select(F.col("start").alias("__k"), F.struct("chain", "reached", "aborted", "status", "final_url", "ips", "found").alias(name))
        s = s.withColumn("__first", F.when(F.col("explicit"), F.col("normalized")).otherwise(secure))
        s = s.join(pick("w1").withColumnRenamed("__k", "__first"), "__first", "left").join(pick("w2").withColumnRenamed("__k", "__second"), F.when(~F.col("explicit"), F.col("normalized")) == F.col("__second"), "left")
        # the second walk counts only if the first didn't reach anything; an aborted walk ends all
        use_first = F.col("explicit") | F.col("w1.reached") | F.col("w1.aborted")
        s = s.withColumn("w", F.when(use_first, F.col("w1")).otherwise(F.col("w2"))).drop("__first", "__second", "w1", "w2", "final_url", "redirect_chain", "aborted")
        s = s.withColumns(
            {
                "aborted": F.coalesce("w.aborted", F.lit(False)),
                "n_walk": F.coalesce("w.found", none()),
                "final_url": F.when(F.coalesce("w.aborted", F.lit(False)), F.col("normalized")).otherwise(F.coalesce("w.final_url", F.col("normalized"))),
                "redirect_chain": F.when(F.coalesce("w.aborted", F.lit(False)), F.array().cast("array<string>")).otherwise(F.array_distinct("w.chain")),
                "resolved_ips": F.when(F.size("resolved_ips") > 0, F.col("resolved_ips")).otherwise(F.coalesce("w.ips", F.col("resolved_ips"))),
                "w_status": F.col("w.status"),
                "w_hops": F.size("w.chain") - 1,
            }
        ).drop("w")
        s = cut(hosted(s, "final_url"))
        final_domain, hops_made = F.coalesce("h_domain", F.lit("")), F.col("w_hops")
        elsewhere = (hops_made > 0) & (final_domain != F.col("registered_domain"))
        from ..plans.analyze import analyze

        targets = s.filter(elsewhere & ~F.col("aborted")).select("final_url").distinct()
        scored = analyze(targets.select(F.col("final_url").alias("__target")), "__target", config, keep=["__target"]).select(F.col("__target").alias("final_url"), F.col("score").alias("t_score"))
        s = lookup_join(s, scored, "final_url")
        short = F.col("host").isin(*config.shorteners) | F.col("registered_domain").isin(*config.shorteners)
        s = s.withColumn(
            "n_chain",
            rules(
                rule("N18", "network", 12, "long chain", hops_made >= LONG_CHAIN),
                rule("N19", "network", 10, F.concat(F.lit("lands on "), final_domain), elsewhere & ~short),
                rule("N20", "network", F.least(F.lit(30), F.floor(F.col("t_score") / 2).cast("int")), "target itself is risky", elsewhere & (F.col("t_score") >= config.medium_threshold)),
            ),
        )
        found += ["n_walk", "n_chain"]
        if options.content:
            # pages are read once a URL that walks end at
            ends = s.select("final_url", "h_scheme", "h_host", "h_domain", "h_ip").distinct()
            bodies = hops.select(F.col("url").alias("final_url"), F.col("content_type").alias("b_type"), F.substring("body", 1, options.body_limit).alias("b_body"))
            domain = F.coalesce("h_domain", F.lit(""))
            ends = listed(ends.join(bodies, "final_url"), "h_domain", config.allowlist, "h_listed")
            distrusted = ~F.coalesce(~F.col("h_ip") & F.col("h_listed") & _own_name(F.col("h_host")), F.lit(False))
            ends = ends.filter((F.length("b_body") > 0) & distrusted).withColumn("page", parse_page(F.col("b_body"), F.col("b_type"), F.col("final_url")))
            broken = F.coalesce(F.col("page.failed") & (F.size(telling_forms(F.col("page"), domain, F.col("h_scheme"))) == 0), F.lit(False))
            ends = ends.select("final_url", broken.alias("p_broken"), F.when(~broken, content_rules(F.col("page"), domain, F.col("h_scheme"), config)).alias("p_found"))
            s = lookup_join(cut(s), cut(ends), "final_url")
            read = ~F.col("aborted") & (F.col("w_status") < 400)
            s = s.withColumns({"n_page": F.coalesce(F.when(read, F.col("p_found")), none()), "aborted_late": F.coalesce(read & F.col("p_broken"), F.lit(False))}).drop("p_found", "p_broken")
            found.append("n_page")
    late = F.col("aborted_late") if "aborted_late" in s.columns else F.lit(False)
    if options.rdap:
        s = cut(s.withColumn("__fd", final_domain))
        pairs = s.select("normalized", "explicit", F.explode(F.array_distinct(F.array("registered_domain", "__fd"))).alias("domain"))
        ages = domain_ages(observation(observations, "rdap_obs", spark), now)
        parts = domain_parts(F.col("domain"))
        pairs = listed(pairs.withColumn("__reg", registered(parts)), "__reg", config.allowlist, "__listed")
        trusted = F.coalesce(F.col("__listed") & _own_name(F.col("domain")), F.lit(False))
        fit = (ipv4_value(F.col("domain")).isNull()) & ~F.col("domain").contains(":") & (parts["suffix"] != "") & ~trusted & ~F.col("domain").isin(*config.shorteners)
        aged = lookup_join(cut(pairs.filter(fit)), ages, "domain")
        missing = F.coalesce("error", F.when(F.col("age").isNull(), F.lit("not observed")))
        aged = aged.select("normalized", "explicit", F.struct("domain", age_rule(F.col("domain"), F.col("age"), missing).alias("r")).alias("x"))
        per = aged.groupBy("normalized", "explicit").agg(F.transform(F.filter(F.array_sort(F.collect_list("x")), lambda x: x["r"].isNotNull()), lambda x: x["r"]).alias("n_age"))  # at most two a URL
        s = s.join(per, ["normalized", "explicit"], "left").withColumn("n_age", F.coalesce(F.col("n_age").cast(RAW), none()))
        found.append("n_age")
    if options.gsb or options.vt:
        s = cut(s)
        gsb = observation(observations, "gsb_obs", spark).select(F.col("url").alias("__t"), F.struct("threat_types", "error").alias("g"))
        vt = observation(observations, "vt_obs", spark).select(F.col("url").alias("__t"), F.struct("has_report", "malicious", "suspicious", "error").alias("v"))
        every = s.select(F.explode(F.array_distinct(F.array("normalized", "final_url"))).alias("__t")).distinct()
        threats = every.join(gsb, "__t", "left").join(vt, "__t", "left").select("__t", threat_rules(F.col("g"), F.col("v"), options).alias("n"))
        threats = cut(threats)
        s = s.join(threats.select(F.col("__t").alias("normalized"), F.col("n").alias("n_t1")), "normalized", "left")
        s = lookup_join(cut(s), threats.select(F.col("__t").alias("final_url"), F.col("n").alias("n_t2")), "final_url")
        s = s.withColumn("n_threat", F.when(F.col("normalized") == F.col("final_url"), F.coalesce("n_t1", none())).otherwise(F.concat(F.coalesce("n_t1", none()), F.coalesce("n_t2", none()))))
        found.append("n_threat")
    stop = rules(rule("N40", "info", 0, "network stage broke off"))
    early = F.concat(*[F.col(c) for c in found if c == "n_dns"], stop) if "n_dns" in found else stop
    until_page = F.concat(*[F.col(c) for c in found if c in ("n_dns", "n_walk", "n_chain")], stop) if found else stop
    every = F.concat(*map(F.col, found)) if found else none()
    out = F.when(F.col("aborted"), early).when(late, until_page).otherwise(every)
    return s.select("normalized", "explicit", out.alias("net"), "resolved_ips", "redirect_chain", "final_url")


def add_network(s: DataFrame, config: Config, options: Options, observations: dict, now: Column) -> DataFrame:
    """Appends the network indicators to `found` of non-terminal rows and adds resolved_ips, redirect_chain, final_url."""
    s = cut(s)
    urls = s.filter(F.col("terminal").isNull()).select("normalized", "explicit", "host", "is_ip", "ip", "registered_domain")
    dim = network_dim(urls, config, options, observations, now)
    # terminal rows have keys that no dimension row has or shouldn't use
    s = s.join(dim, ["normalized", "explicit"], "left")
    live = F.col("terminal").isNull() & F.col("net").isNotNull()
    shifted = F.transform("net", lambda x, i: F.struct((F.size("found") + i).cast("int").alias("seq"), x["rule_id"].alias("rule_id"), x["category"].alias("category"), x["points"].alias("points"), x["message"].alias("message")))
    s = s.withColumn("found", F.when(live, F.concat("found", shifted)).otherwise(F.col("found")))
    for c in ("resolved_ips", "redirect_chain", "final_url"):
        s = s.withColumn(c, F.when(live, F.col(c)))
    return s.drop("net")


__all__ = ["walk", "dns_rules", "dns_table", "network_dim", "add_network", "content_rules", "domain_ages", "age_rule", "threat_rules"]
