"""Queries of problem 6: results per domain and per host, whatever share of the rows they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import Measure, eager_join_aggregate
from ..runtime import table

#: A value belongs to p6_found when it holds this share of all rows.
HOT_SHARE = 0.01

FIRST = Measure("result_id", "first", "result_id", order=("scan_ts", "result_id"))


def _per_key(spark: SparkSession, folder: str, measures: list[Measure]) -> tuple[DataFrame, DataFrame]:
    results = table(spark, folder, "results")
    hosts = table(spark, folder, "hostinfo").select(F.col("host").alias("hostname"), "free_hosting")
    keep = ["registered_domain", "hostname", *dict.fromkeys(c for m in measures if m.side == "left" for c in (m.column, *m.order))]
    left = results.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in keep[:2] else F.col(c) for c in dict.fromkeys(keep)])
    right = hosts.withColumn("free", F.col("free_hosting").cast("bigint"))
    return results, eager_join_aggregate(left, right, "hostname", ["registered_domain", "hostname"], measures, how="left")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """(field, item, result_id): first row by scan_ts, then result_id, of every value held by 1 % of all rows."""
    results, states = _per_key(spark, folder, [FIRST])
    total = results.agg(F.count(F.lit(1)).alias("total"))  # one row
    hot = states.join(F.broadcast(total), F.col("left_rows") >= F.col("total") * F.lit(HOT_SHARE))
    return hot.select("field", "item", "result_id")


def p6_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Per domain and host over results JOIN hostinfo: rows, joined rows, summed score, spellings on free hosting."""
    measures = [Measure("score_sum", "sum", "score"), Measure("free_spellings", "sum", "free", side="right")]
    _, states = _per_key(spark, folder, measures)
    return states


SQL = {
    "p6_found": """
        WITH r AS (SELECT result_id, scan_ts, registered_domain, hostname FROM results),
        u AS (SELECT 'registered_domain' AS field, registered_domain AS item, scan_ts, result_id FROM r
              UNION ALL SELECT 'hostname', hostname, scan_ts, result_id FROM r),
        k AS (SELECT *, count(*) OVER (PARTITION BY field, item) AS n,
                     row_number() OVER (PARTITION BY field, item ORDER BY scan_ts NULLS LAST, result_id) AS rn
              FROM u WHERE item <> '')
        SELECT field, item, result_id FROM k WHERE rn = 1 AND n >= 0.01 * (SELECT count(*) FROM r)
    """,
    "p6_observations": """
        WITH h AS (SELECT host, count(*) AS spellings, sum(free_hosting::BIGINT)::BIGINT AS free FROM hostinfo GROUP BY host),
        j AS (SELECT nullif(registered_domain, '') AS registered_domain, nullif(hostname, '') AS hostname, score, free, coalesce(spellings, 1) AS n
              FROM results LEFT JOIN h ON hostname = host AND hostname <> ''),
        u AS (SELECT 'registered_domain' AS field, registered_domain AS item, score, free, n FROM j
              UNION ALL SELECT 'hostname', hostname, score, free, n FROM j)
        SELECT field, item, count(*)::BIGINT AS left_rows, sum(n)::BIGINT AS joined_rows,
               sum(score * n)::BIGINT AS score_sum, sum(free)::BIGINT AS free_spellings
        FROM u WHERE item IS NOT NULL GROUP BY field, item
    """,
}

QUERIES = {"p6_found": p6_found, "p6_observations": p6_observations}
