"""Live look-ups for a scan: the observation tables that its options need, asked for now. Opt-in; see providers."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Options
from ..functions.hosts import join_url
from ..functions.urls import parse
from ..operators.network import REDIRECTS, hosted
from ..runtime import cut
from . import providers


def asking(options: Options, keys: Mapping[str, str]) -> dict[str, Callable[[str], dict]]:
    """The look-up of each observation table; those of services that need a key only where it is given."""
    made: dict[str, Callable[[str], dict]] = {
        "dns_obs": partial(providers.resolve, timeout=options.timeout),
        "hop_obs": partial(providers.fetch, timeout=options.timeout, body_limit=options.body_limit if options.content else 0, allow_private=options.allow_private),
        "rdap_obs": providers.registration,
    }
    for name, look in (("gsb", providers.safe_browsing), ("vt", providers.engines_report)):
        if keys.get(name):
            made[f"{name}_obs"] = partial(look, key=keys[name])
    return made


def observations(urls: DataFrame, column: str, options: Options, keys: Mapping[str, str] | None = None, tasks: int = 8, ask: Mapping[str, Callable] | None = None) -> dict[str, DataFrame]:
    """Observation tables by name for scanning urls[column] with options. Each distinct key is asked for once; pages are
    followed as far as options.max_redirects. ask: other look-ups than asking(), for tests."""
    ask = ask or asking(options, keys or {})

    def seen(keys_: DataFrame, key: str, name: str) -> DataFrame:
        return cut(providers.run(keys_, key, name, ask[name], tasks))

    parsed = cut(parse(urls.select(F.col(column).alias("__url")), "__url").filter("valid and special is null").select("normalized", "explicit", "host", "is_ip", "registered_domain"))
    made = {"dns_obs": [seen(parsed.filter("not is_ip").select("host"), "host", "dns_obs")]}
    domains, targets = parsed.select(F.col("registered_domain").alias("domain")), parsed.select(F.col("normalized").alias("url"))
    if options.fetches:
        secure = F.regexp_replace("normalized", "^http://", "https://")
        todo = parsed.select(F.explode(F.when(F.col("explicit"), F.array("normalized")).otherwise(F.array(secure, "normalized"))).alias("url")).distinct()
        known, made["hop_obs"] = todo, []
        for _ in range(options.max_redirects + 1):
            hops = seen(todo, "url", "hop_obs")
            made["hop_obs"].append(hops)
            leads = hops.filter(F.col("status").isin(REDIRECTS) & (F.length("location") > 0)).select(join_url(F.col("url"), F.col("location"))["url"].alias("url"))
            todo = cut(leads.filter("url is not null").distinct().join(known, "url", "left_anti"))
            if todo.isEmpty():
                break
            known = known.unionAll(todo)
            there = cut(hosted(todo, "url"))
            made["dns_obs"].append(seen(there.filter("not h_ip").select(F.col("h_host").alias("host")), "host", "dns_obs"))
            domains = domains.unionAll(there.select("h_domain"))
            targets = targets.unionAll(todo)
    if options.rdap:
        made["rdap_obs"] = [seen(domains.filter("domain like '%.%'"), "domain", "rdap_obs")]
    for name in ("gsb", "vt"):
        if getattr(options, name) and f"{name}_obs" in ask:
            made[f"{name}_obs"] = [seen(targets, "url", f"{name}_obs")]
    return {name: reduce(DataFrame.unionByName, tables) for name, tables in made.items()}
