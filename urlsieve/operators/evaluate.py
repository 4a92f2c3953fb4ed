"""Detection quality over thresholds (AG-4). Scores take at most 101 values, so everything after one small aggregate is tiny."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The thresholds of the sweep.
SWEEP = list(range(5, 100, 5))


def metrics(scores: DataFrame, thresholds: list[int]) -> DataFrame:
    """scores(score, bad boolean): (threshold, tp, fp, tn, fn, precision, recall, f1) for each distinct threshold.

    A null score is below every threshold. Zero denominators give 0.0. No scores: counts of 0.
    """
    histogram = scores.groupBy("score", "bad").agg(F.count(F.lit(1)).alias("n"))  # at most 202 rows and nulls
    at = scores.sparkSession.createDataFrame([(t,) for t in sorted(set(thresholds))], "threshold int")
    above = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    count = lambda bad, hit: F.coalesce(F.sum(F.when((F.col("bad") == bad) & (above == hit), F.col("n"))), F.lit(0)).cast("int")
    counted = at.join(F.broadcast(histogram), F.lit(True), "left").groupBy("threshold").agg(count(True, True).alias("tp"), count(False, True).alias("fp"), count(False, False).alias("tn"), count(True, False).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    rated = counted.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    both = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / F.when(both > 0, both)).otherwise(F.lit(0.0)))


def best(rated: DataFrame) -> DataFrame:
    """The row of the largest F1; of equal ones that of the highest threshold."""
    row = F.struct(*rated.columns)
    return rated.agg(F.max_by(row, F.struct("f1", "threshold")).alias("b")).select("b.*")


def evaluate(good: DataFrame, bad: DataFrame, config=None, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(metrics of the sweep and of both configured thresholds, best row of the sweep) for two URL frames, scored offline."""
    from ..config import get_default_config
    from ..plans.analyze import analyze

    config = config or get_default_config()
    both = good.select(F.col(url).alias("url"), F.lit(False).alias("bad")).unionAll(bad.select(F.col(url).alias("url"), F.lit(True).alias("bad")))
    scores = analyze(both, "url", config, keep=["bad"]).select("score", "bad")
    rated = metrics(scores, [*SWEEP, config.medium_threshold, config.high_threshold])
    return rated, best(rated.filter(F.col("threshold").isin(SWEEP)))
