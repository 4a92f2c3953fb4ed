"""Scores and classes from indicators. One fold of doubles in order of first appearance, as sums depend on the order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import refdata as R
from ..config import Config


def compute_score(indicators: Column, allowlisted: Column, config: Config) -> Column:
    """AG-1: category sums, capped, soft ones scaled where allowlisted, summed, rounded half to even, at most 100.

    A single indicator of 100 points forces 100. Null or no indicators give 0; null points count as none.
    """
    scored = F.filter(indicators, lambda i: i["points"] > 0)
    caps = F.create_map(*[F.lit(x) for kv in config.category_caps.items() for x in kv]) if config.category_caps else None
    categories = F.array_distinct(F.transform(scored, lambda i: i["category"]))

    def total(acc: Column, cat: Column) -> Column:
        points = F.aggregate(F.filter(scored, lambda i: i["category"].eqNullSafe(cat)), F.lit(0).cast("bigint"), lambda a, i: a + i["points"])
        capped = points if caps is None else F.least(points, caps[cat])  # least() passes over a missing cap
        soft = F.coalesce(allowlisted, F.lit(False)) & F.coalesce(cat.isin(R.SOFT_CATEGORIES), F.lit(False))
        return acc + F.when(soft, capped.cast("double") * F.lit(float(config.allowlist_factor))).otherwise(capped.cast("double"))

    summed = F.least(F.coalesce(F.rint(F.aggregate(categories, F.lit(0.0), total)), F.lit(0.0)), F.lit(100.0)).cast("int")
    forced = F.exists(indicators, lambda i: i["points"] >= 100)
    return F.when(F.coalesce(forced, F.lit(False)), 100).otherwise(F.coalesce(summed, F.lit(0)))


def classify(score: Column, config: Config) -> Column:
    """AG-2."""
    return F.when(score >= config.high_threshold, R.CLASS_HIGH).when(score >= config.medium_threshold, R.CLASS_MEDIUM).otherwise(R.CLASS_LOW)


def ordered(indicators: Column) -> Column:
    """AG-3: most points first, then emission order."""
    keyed = F.transform(indicators, lambda i: F.struct((-i["points"]).alias("k"), i["seq"].alias("s"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda x: x["i"])
