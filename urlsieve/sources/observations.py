"""Recorded observations: DNS answers, HTTP hops, registration data, threat reports. One row per key: the latest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMAS = {
    "dns_obs": "host string, ips array<string>, error string, obs_id bigint, obs_ts timestamp_ntz",
    "hop_obs": "url string, status int, location string, content_type string, body binary, tls_error string, cert_not_before timestamp_ntz, failure string, obs_id bigint, obs_ts timestamp_ntz",
    "rdap_obs": "domain string, events array<struct<eventAction: string, eventDate: string>>, error string, obs_id bigint, obs_ts timestamp_ntz",
    "gsb_obs": "url string, threat_types array<string>, error string, obs_id bigint, obs_ts timestamp_ntz",
    "vt_obs": "url string, has_report boolean, malicious int, suspicious int, error string, obs_id bigint, obs_ts timestamp_ntz",
}
KEYS = {"dns_obs": "host", "hop_obs": "url", "rdap_obs": "domain", "gsb_obs": "url", "vt_obs": "url"}


def latest(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """One row per non-null key: the columns of the observation with the largest (obs_ts, obs_id), nulls first.

    Partial aggregation keeps one row per key and task, so a key with very many observations is no burden.
    """
    columns = columns or [c for c in df.columns if c not in (key, "obs_id", "obs_ts")]
    order = [F.col(c) for c in ("obs_ts", "obs_id") if c in df.columns]
    rank = F.struct(*order) if order else F.xxhash64(*[c for c in columns])
    made = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), rank).alias("__o"))
    return made.select(key, *[F.col("__o")[c].alias(c) for c in columns])


def observation(observations: dict[str, DataFrame], name: str, spark) -> DataFrame:
    """The latest rows of an observation table, or an empty one where it isn't given."""
    df = observations.get(name)
    if df is None:
        df = spark.createDataFrame([], SCHEMAS[name])
    return latest(df, KEYS[name])
