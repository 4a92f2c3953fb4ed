"""Block-listed URLs and domains (B1, J-3, J-4): equality joins on keys; suffixes are exploded for distinct
hosts only, and what a key or host finds goes back to its rows with hot ones split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_key, host_suffixes
from ..runtime import cut
from .skew import lookup_join

#: Fixed value: points of a block-list hit.
POINTS = 70


def match_hosts(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """hosts(host), domains(domain): (host, domain) with the longest listed suffix of each host that has one."""
    parents = hosts.select("host").filter("host <> ''").distinct().select("host", F.posexplode(host_suffixes(F.col("host"))).alias("depth", "domain"))
    hit = parents.join(domains.select("domain").distinct(), "domain")
    return hit.groupBy("host").agg(F.min_by("domain", "depth").alias("domain"))


def add_blocklist(s: DataFrame, urls: DataFrame, domains: DataFrame) -> DataFrame:
    """Appends B1 to `found` of non-terminal rows. A URL hit beats a domain hit."""
    keys = urls.select(F.col("key").alias("__key")).distinct().withColumn("__url_hit", F.lit(True))
    s = cut(s.withColumn("__key", canonical_key(F.col("normalized"))))
    hosts = match_hosts(s.filter(F.col("terminal").isNull()).select("host"), domains).select("host", F.col("domain").alias("__domain"))
    s = lookup_join(cut(lookup_join(s, keys, "__key")), hosts, "host")
    what = F.when(F.col("__url_hit"), F.lit("URL")).when(F.col("__domain").isNotNull(), F.concat(F.lit("domain "), F.col("__domain")))
    hit = F.struct(F.size("found").alias("seq"), F.lit("B1").alias("rule_id"), F.lit("intel").alias("category"), F.lit(POINTS).alias("points"), F.concat(F.lit("block-listed "), what).alias("message"))
    found = F.when(what.isNotNull() & F.col("terminal").isNull(), F.concat("found", F.array(hit))).otherwise(F.col("found"))
    return s.withColumn("found", found).drop("__key", "__url_hit", "__domain")
