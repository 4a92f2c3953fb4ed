"""The scan: URLs in, one result row each out. Offline stages are row-local projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..config import Config, Options, get_default_config
from ..functions.urls import parse
from ..operators.brand import brand_candidates, brand_indicators
from ..operators.rules import keywords, numbered, static_groups, texts
from ..operators.score import classify, compute_score, ordered
from ..runtime import ship

#: Emission order of the groups.
ORDER = ("defanged", "scheme", "length", "deception", "host", "lexical", "hosting", "encoding", "ports", "path", "payload", "brand")

RESULT = ("url", "normalized_url", "hostname", "hostname_unicode", "registered_domain", "ip_address", "allowlisted", "score", "classification", "reasons", "indicators", "resolved_ips", "redirect_chain", "final_url")
_NONE = "array<struct<seq: int, rule_id: string, category: string, points: int, message: string>>"


def facts(df: DataFrame, url: str, config: Config) -> DataFrame:
    """df with parse columns, texts, keywords and g_* rule groups, and `terminal` (T1 .. T5 or null)."""
    s = parse(df, url, texts=True)
    s = brand_candidates(keywords(texts(s, config), config), config)
    s = brand_indicators(static_groups(s, config))
    return s.withColumn(
        "terminal",
        F.when(F.col("special").isin(R.DANGEROUS_SCHEMES), "T1").when(F.col("special").isNotNull(), "T2").when(F.col("crashed"), "T5").when(F.col("broken"), "T3").when(~F.col("valid"), "T4"),
    )


def _terminal(rule: str, category: str, points: int, message: str) -> Column:
    return F.array(F.struct(F.lit(0).alias("seq"), F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), F.lit(points).alias("points"), F.lit(message).alias("message"))).cast(_NONE)


def static_indicators(s: DataFrame) -> DataFrame:
    """Adds `found`: all static indicators in emission order; empty for terminal rows."""
    raw = F.concat(*[F.col(f"g_{g}") for g in ORDER])
    return s.withColumn("found", F.when(F.col("terminal").isNull(), numbered(raw)).otherwise(F.array().cast(_NONE)))


def finish(s: DataFrame, keep: list[str], config: Config) -> DataFrame:
    """keep + the result columns, from rows with found, terminal, parse columns, resolved_ips, redirect_chain, final_url."""
    trusted = F.col("terminal").isNull() & F.col("allowlisted")
    end = F.col("terminal").isNotNull()
    ended = (
        F.when(F.col("terminal") == "T1", _terminal("T1", "deception", 100, "scheme that runs code"))
        .when(F.col("terminal") == "T2", _terminal("T2", "info", 0, "not a web address"))
        .when(F.col("terminal") == "T3", _terminal("T3", "deception", 100, "address can't be split"))
        .when(F.col("terminal") == "T5", _terminal("T5", "deception", 100, "address could not be analysed"))
        .otherwise(_terminal("T4", "deception", 100, "address without a host"))
    )
    s = s.withColumns({"score": F.when(end, F.when(F.col("terminal") == "T2", 0).otherwise(100)).otherwise(compute_score(F.col("found"), trusted, config)), "__trusted": trusted})
    scaled = F.struct((F.size("found")).alias("seq"), F.lit("AL").alias("rule_id"), F.lit("info").alias("category"), F.lit(0).alias("points"), F.lit("domain is on the allowlist").alias("message"))
    every = F.when(F.col("__trusted"), F.concat("found", F.array(scaled).cast(_NONE))).otherwise(F.col("found"))
    s = s.withColumn("indicators", F.when(end, ended).otherwise(ordered(every)))
    shown = lambda c: F.when(end, "").otherwise(c)
    normal = F.when(F.col("special").isNotNull(), "").otherwise(F.col("normalized"))
    none = F.array().cast("array<string>")
    return s.select(
        *keep,
        F.col("given").alias("url"),
        normal.alias("normalized_url"),
        shown(F.col("host")).alias("hostname"),
        shown(F.col("host_uni")).alias("hostname_unicode"),
        shown(F.col("registered_domain")).alias("registered_domain"),
        (F.col("is_ip") & ~end).alias("ip_address"),
        F.col("__trusted").alias("allowlisted"),
        "score",
        F.when(end, F.when(F.col("terminal") == "T1", R.CLASS_HIGH).when(F.col("terminal") == "T2", R.CLASS_NOT_WEB).otherwise(R.CLASS_INVALID)).otherwise(classify(F.col("score"), config)).alias("classification"),
        F.transform("indicators", lambda i: i["message"]).alias("reasons"),
        "indicators",
        F.coalesce("resolved_ips", none).alias("resolved_ips") if "resolved_ips" in s.columns else none.alias("resolved_ips"),
        F.coalesce("redirect_chain", none).alias("redirect_chain") if "redirect_chain" in s.columns else none.alias("redirect_chain"),
        (F.coalesce("final_url", normal) if "final_url" in s.columns else F.when(normal == "", F.col("given")).otherwise(normal)).alias("final_url"),
    )


def analyze(
    df: DataFrame,
    url: str = "url",
    config: Config | None = None,
    options: Options | None = None,
    keep: list[str] | None = None,
    blocklist: tuple[DataFrame, DataFrame] | None = None,
    observations: dict[str, DataFrame] | None = None,
    now: Column | None = None,
) -> DataFrame:
    """DR-2: one result row per row of df, with the columns `keep` of df in front.

    Offline (no blocklist, no network option, an allowlist that fits the plan) there is no join and no shuffle, and df
    may be a stream. Filter results behind checkpoint(), cache() or a written table: Spark carries a filter on a result
    column down to the scan, where it stands for all the rules that make the column. blocklist:
    (URL keys, domains) from sources.files.read_blocklist. observations: tables of sources.observations by name, for
    the network options; now: the time that ages are measured against (default current_timestamp()).
    A null URL gives an invalid result. Columns of df outside `keep` don't matter, whatever their names; columns of
    `keep` must not be named like result columns.
    """
    config, options, keep = config or get_default_config(), options or Options(), keep or []
    ship(df.sparkSession)
    names = {k: f"__keep_{i}" for i, k in enumerate(keep)}
    s = df.select(F.col(url).alias("__given"), *[F.col(k).alias(v) for k, v in names.items()])
    s = static_indicators(facts(s, "__given", config))
    if blocklist is not None:
        from ..operators.blocklist import add_blocklist

        s = add_blocklist(s, *blocklist)
    if options.uses_network:
        from ..operators.network import add_network

        s = add_network(s, config, options, observations or {}, now if now is not None else F.current_timestamp())
    out = finish(s, list(names.values()), config)
    return out.select(*[F.col(v).alias(k) for k, v in names.items()], *RESULT)
