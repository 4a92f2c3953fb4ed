"""Most frequent items in bounded memory (problem 4): Misra-Gries summaries, merged, then counted.

A summary of COUNTERS counters over n rows undercounts by at most n / (COUNTERS + 1), so it holds every item above
that many rows. Partitions are summarised in one pass, summaries merge in three rounds by adding counters and
subtracting the next-largest one; a second pass counts the at most COUNTERS candidates exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table

COUNTERS = 1000
FAN_IN = 64
#: p4_found: the share of all rows that a value must hold.
SHARE = 0.005

SUMMARY = "part bigint, field string, item string, counter bigint, n bigint"


def shrink(items: pa.Array, counts: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """Keep at most k counters: subtract the (k + 1)-th largest from all and drop what is not positive."""
    if len(counts) > k:
        counts = counts - np.partition(counts, len(counts) - k - 1)[len(counts) - k - 1]
        keep = counts > 0
        items, counts = items.filter(pa.array(keep)), counts[keep]
    return items, counts


def merge(a: tuple[pa.Array, np.ndarray], b: tuple[pa.Array, np.ndarray], k: int) -> tuple[pa.Array, np.ndarray]:
    both = pa.table({"i": pa.concat_arrays([a[0], b[0]]), "c": pa.array(np.concatenate([a[1], b[1]]))}).group_by("i").aggregate([("c", "sum")])
    return shrink(both.column("i").combine_chunks(), both.column("c_sum").to_numpy(), k)


def _summarise(fields: list[str], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kept = {f: (pa.array([], pa.string()), np.empty(0, np.int64)) for f in fields}
        n = 0
        for batch in batches:
            n += batch.num_rows
            for i, f in enumerate(fields):
                column = batch.column(i).cast(pa.string())
                counted = pc.value_counts(column.drop_null())
                kept[f] = merge(kept[f], (counted.field(0), counted.field(1).to_numpy(zero_copy_only=False)), k)
        for f in fields:
            items, counts = kept[f]
            m = len(items)
            if m:
                yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int64()), pa.array([f] * m), items, pa.array(counts, pa.int64()), pa.array([n] * m, pa.int64())], names=["part", "field", "item", "counter", "n"])

    return run


def summaries(df: DataFrame, fields: list[str], k: int = COUNTERS) -> DataFrame:
    """(part, field, item, counter, n): the summary of each partition; n are its rows. Nulls are no items."""
    return df.select(*fields).mapInArrow(_summarise(fields, k), SUMMARY)


def merged(parts: DataFrame, k: int = COUNTERS) -> DataFrame:
    """One summary per field out of all summaries, whatever their number; same columns.

    Three rounds merge by the partition's number, modulo FAN_IN squared, modulo FAN_IN, and by field alone, so that a
    task merges FAN_IN summaries or, of more than FAN_IN cubed partitions, in proportion.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = (pa.array([], pa.string()), np.empty(0, np.int64))
        n = 0
        for _, p in pdf.groupby("part", sort=True):
            n += int(p["n"].iloc[0])
            out = merge(out, (pa.array(p["item"], pa.string()), p["counter"].to_numpy(np.int64)), k)
        part, field = int(pdf["to"].iloc[0]), pdf["field"].iloc[0]
        return pd.DataFrame({"part": part, "field": field, "item": out[0].to_pandas(), "counter": out[1], "n": n})

    for groups in (FAN_IN**2, FAN_IN, 1):
        parts = parts.withColumn("to", F.pmod("part", F.lit(groups))).groupBy("field", "to").applyInPandas(lambda pdf: fold(pdf), SUMMARY)
    return parts


def frequent(df: DataFrame, fields: list[str], share: float, k: int = COUNTERS) -> DataFrame:
    """(field, item, rows, estimate, total) of every non-null item held by at least `share` of all rows of df.

    Needs share > 1 / (k + 1), which guarantees that no such item is missing. Ties all come out. Empty df: no rows.
    """
    if share * (k + 1) <= 1:
        raise ValueError("share must exceed 1 / (k + 1)")
    found = merged(summaries(df, fields, k), k)
    # an undercount is at most a k + 1-th of the rows, nulls included
    total = df.agg(F.count(F.lit(1)).alias("total"))
    candidates = found.join(F.broadcast(total)).filter(F.col("counter") + F.col("total") / (k + 1) >= share * F.col("total"))
    flat = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("item")) for f in fields])).alias("s")).select("s.*").filter("item is not null")
    # at most 1 / (share - 1 / (k + 1)) candidates a field
    counted = flat.join(F.broadcast(candidates.select("field", "item", F.col("counter").alias("estimate"), "total")), ["field", "item"])
    exact = counted.groupBy("field", "item").agg(F.count(F.lit(1)).alias("rows"), F.max("estimate").alias("estimate"), F.max("total").alias("total"))
    return exact.filter(F.col("rows") >= share * F.col("total"))


FIELDS = ["registered_domain", "final_url"]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(field, item) held by at least 0.5 % of all rows of results."""
    return frequent(table(spark, folder, "results").select(*FIELDS), FIELDS, SHARE).select("field", "item")


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(field, item, rows) of the values of p4_found."""
    return frequent(table(spark, folder, "results").select(*FIELDS), FIELDS, SHARE).select("field", "item", "rows")


def p4_summary(spark: SparkSession, folder: str) -> DataFrame:
    """(field, item, estimate, at_most): the merged summary itself, with the bound on each true count."""
    df = table(spark, folder, "results").select(*FIELDS)
    found = merged(summaries(df, FIELDS))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return found.join(F.broadcast(total)).select("field", "item", F.col("counter").alias("estimate"), (F.col("counter") + F.floor(F.col("total") / (COUNTERS + 1))).alias("at_most"))


QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts, "p4_summary": p4_summary}

_COUNTED = """
    WITH u AS (SELECT 'registered_domain' AS field, registered_domain AS item FROM results
               UNION ALL SELECT 'final_url', final_url FROM results)
    SELECT field, item{0} FROM u WHERE item IS NOT NULL
    GROUP BY field, item HAVING count(*) >= 0.005 * (SELECT count(*) FROM results)
"""
SQL = {"p4_found": _COUNTED.format(""), "p4_counts": _COUNTED.format(", count(*)::BIGINT AS rows")}
