"""Joins and aggregates that stay even when one key holds a third of all rows (core, problem 6).

eager_join_aggregate pre-aggregates both inputs by the join key, joins the compact states, and rolls them up:
no row of either input takes part in the join itself, so a hot key costs one state row a map task.
salted_join spreads the rows of hot keys that must be joined row by row over several tasks; lookup_join finds what each
distinct key has and brings it back that way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one task may take of one key before the key is split.
HOT_ROWS = 200_000
#: Keys that are split at most: the largest ones. One that isn't among them holds less than a 10,000th of the rows.
MOST_HOT = 10_000


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: str, hot_rows: int = HOT_ROWS, how: str = "inner", most_hot: int = MOST_HOT) -> DataFrame:
    """Join left to right on keys (equality; a null key joins nothing); right[rows] is the number of left rows of its key.

    The most_hot largest keys with more than hot_rows left rows are split into ceil(rows / hot_rows) parts: left rows
    take a part by the hash of all their columns, right rows are repeated once a part. The broadcast list of split keys
    has at most most_hot rows. how='left' keeps left rows without a partner; those with a null key are spread over all
    tasks, as they need none. A key that is repeated in right is split alike for all its rows. Column `rows` is dropped.
    """
    assert how in ("inner", "left")
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    right = right.filter(known)
    parts = F.ceil(F.col(rows) / F.lit(max(hot_rows, 1))).cast("int")
    hot = right.groupBy(*keys).agg(F.max(parts).alias("__parts")).filter(F.col("__parts") > 1).orderBy(F.desc("__parts")).limit(most_hot)
    salt = F.pmod(F.xxhash64(*left.columns), F.coalesce("__parts", F.when(~known, F.lit(1 << 20)), F.lit(1)).cast("bigint")).cast("int")
    salted = left.join(F.broadcast(hot), list(keys), "left").withColumn("__salt", salt)
    spread = right.join(F.broadcast(hot), list(keys), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1)))
    out = salted.drop("__parts").join(spread.drop("__parts", rows), [*keys, "__salt"], how)
    return out.drop("__salt")


def lookup_join(left: DataFrame, right: DataFrame, key: str, hot_rows: int = HOT_ROWS, how: str = "left") -> DataFrame:
    """Join left to right, which has one row a key at most, however many left rows a key holds.

    Only the distinct keys of left (counted before the shuffle) meet right; what they find goes back by salted_join.
    """
    counted = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    return salted_join(left, counted.join(right, key), [key], "__rows", hot_rows, how)


@dataclass(frozen=True)
class Measure:
    """One aggregate over the joined rows. kind: 'sum' or 'first' (the value of `column` in the first row by `order`)."""

    name: str
    kind: str
    column: str
    side: str = "left"
    order: tuple[str, ...] = ()


def _first(column: str, order: Sequence[str]) -> Column:
    """A struct whose minimum belongs to the first row; nulls in the order come last."""
    parts: list[Column] = []
    for i, c in enumerate(order):
        parts += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"o{i}")]
    return F.min(F.struct(*parts, F.col(column).alias("v")))


def _state(df: DataFrame, groups: Sequence[str], measures: Sequence[Measure], count: str) -> DataFrame:
    made = [F.count(F.lit(1)).alias(count)]
    for m in measures:
        made.append((F.sum(m.column) if m.kind == "sum" else _first(m.column, m.order)).alias(m.name))
    return df.groupBy(*groups).agg(*made)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: str,
    rollups: Sequence[str],
    measures: Sequence[Measure] = (),
    how: str = "inner",
) -> DataFrame:
    """Aggregate left JOIN right ON on, grouped by each of rollups apart, without joining rows.

    left holds `on` and the rollup columns; right holds `on`. Output, one row per rollup column and non-null value:
    field (the rollup column's name), item, left_rows (rows of left), joined_rows (rows of the join), and the measures.
    Both inputs shrink to one state a (join key, rollup value); counts multiply, sums scale by the other side's count,
    first values carry over. how='left' keeps left rows without partner (they count once, right sums are null).
    Null join keys have no partner. Null rollup values give no row. Empty inputs give no rows.
    """
    lm = [m for m in measures if m.side == "left"]
    rm = [m for m in measures if m.side == "right"]
    assert all(m.kind == "sum" for m in rm), "first values come from the left side"
    groups = list(dict.fromkeys([on, *rollups]))
    a = _state(left, groups, lm, "__l")
    b = _state(right.filter(F.col(on).isNotNull()), [on], rm, "__r")
    joined = a.filter(F.col(on).isNotNull()).join(b, on, how)
    if how == "left":
        # states without a join key have no partner and stay out of the join, which would bring them to one task
        joined = joined.unionByName(a.filter(F.col(on).isNull()), allowMissingColumns=True)
    r = F.coalesce(F.col("__r"), F.lit(1).cast("bigint"))
    wide = joined.select(
        *[F.col(g) for g in groups],
        F.col("__l"),
        (F.col("__l") * r).alias("__j"),
        *[(F.col(m.name) * r if m.kind == "sum" else F.col(m.name)).alias(m.name) for m in lm],
        *[(F.col(m.name) * F.col("__l")).alias(m.name) for m in rm],
    )
    fields = F.explode(F.array(*[F.struct(F.lit(g).alias("field"), F.col(g).cast("string").alias("item")) for g in rollups]))
    flat = wide.select(fields.alias("__f"), "*").select("__f.*", "__l", "__j", *[m.name for m in measures]).filter(F.col("item").isNotNull())
    rolled = flat.groupBy("field", "item").agg(
        F.sum("__l").alias("left_rows"),
        F.sum("__j").alias("joined_rows"),
        *[(F.sum(m.name) if m.kind == "sum" else F.min(m.name)).alias(m.name) for m in measures],
    )
    return rolled.select("field", "item", "left_rows", "joined_rows", *[(F.col(m.name) if m.kind == "sum" else F.col(f"{m.name}.v")).alias(m.name) for m in measures])
