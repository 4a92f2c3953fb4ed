"""Filling fixed-capacity containers with whole documents (problem 7).

Sizes are integers up to the capacity, so all that is planned is a histogram of at most `capacity` rows, whatever the
number of documents. Large sizes are rounded up within groups of equal cardinality (linear grouping), a configuration
linear program over the few group sizes is solved by column generation, its configurations are filled with actual
sizes, and everything else goes by best fit, largest first, into the room that is left. The plan is a list of ranges
"items number a to b of size s go to containers c, c + 1, ..."; documents find their range by their number among
documents of their size, which is computed without a global sort.
"""

from __future__ import annotations

import base64
import functools
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut, table

CAPACITY = 2048
#: Largest vocabulary file that is sent to the workers.
MAX_VOCABULARY = 64 << 20
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Plans that are tried: (groups of equal cardinality among the large sizes, parts of the capacity above which a size is
#: large). A plan takes a second, so the one with the fewest containers is kept.
TRIED = ((24, 4), (64, 3), (24, 3), (64, 2))
#: Rounds of column generation at most; the plan is valid whenever it stops.
ROUNDS = 200
#: Documents of one size that one task numbers.
NUMBERED = 50_000

#: Fixed value: how byte-level BPE vocabularies of this family split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens): the number of tokens of each whole text; 0 for null and empty.

    The vocabulary is read where the driver is and sent along, so workers need no file.
    """
    with open(path, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read(MAX_VOCABULARY))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(sent.value)
        for f in frames:
            yield pd.DataFrame({"doc_id": f.iloc[:, 0], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in f.iloc[:, 1]]})

    return df.select(id_col, text_col).mapInPandas(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, tokens bigint")


# ---------------------------------------------------------------- configurations


def _best_column(weights: list[int], value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of largest value (unbounded knapsack over the group sizes)."""
    best = [0.0] * (capacity + 1)
    took = [-1] * (capacity + 1)
    pairs = [(w, float(v), g) for g, (w, v) in enumerate(zip(weights, value)) if v > 1e-12]
    for c in range(1, capacity + 1):
        b, t = best[c - 1], -1
        for w, v, g in pairs:
            if w <= c and best[c - w] + v > b + 1e-12:
                b, t = best[c - w] + v, g
        best[c], took[c] = b, t
    column = np.zeros(len(weights))
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            column[took[c]] += 1
            c -= weights[took[c]]
    return best[capacity], column


def configurations(weights: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(items of each group in a container, number of such containers) from the configuration linear program, rounded
    down, so that no group is used beyond its demand."""
    k = len(weights)
    if not k:
        return []
    columns = np.diag([float(capacity // w) for w in weights])
    x = np.array(demand, float) / np.diag(columns)
    for _ in range(ROUNDS):
        inverse = np.linalg.inv(columns)
        value, column = _best_column(weights, np.ones(k) @ inverse, capacity)
        if value <= 1 + 1e-7:
            break
        change = inverse @ column
        ratio = np.where(change > 1e-9, x / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * change, 0)
        x[out] = ratio[out]
        columns[:, out] = column
        if abs(np.linalg.det(columns)) < 1e-9:
            break
    made, left = [], np.array(demand, np.int64)
    for i in np.argsort(-x):
        column = columns[:, i].astype(np.int64)
        n = int(x[i] + 1e-9)
        if column.any():
            n = min(n, int((left[column > 0] // column[column > 0]).min()))
            if n > 0:
                made.append((column, n))
                left -= n * column
    return made


# ---------------------------------------------------------------- plan


class Plan:
    """Ranges (size, first number, count, first container) and the number of containers."""

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int, parts: int) -> None:
        self.capacity = capacity
        self.ranges: list[tuple[int, int, int, int]] = []
        self.containers = 0
        self.left = {s: n for s, n in histogram.items() if n > 0 and s > 0}
        assert all(s <= capacity for s in self.left), "split larger items first"
        self.next = dict.fromkeys(self.left, 0)
        self.room: list[int] = []  # sizes of free room, sorted
        self.runs: dict[int, list[tuple[int, int]]] = {}  # free room -> (first container, count)
        self._large(groups, parts)
        self._best_fit()

    def _take(self, size: int, count: int, container: int) -> None:
        self.ranges.append((size, self.next[size], count, container))
        self.next[size] += count
        self.left[size] -= count

    def _free(self, room: int, first: int, count: int) -> None:
        if count <= 0:
            return
        if room not in self.runs:
            insort(self.room, room)
            self.runs[room] = []
        self.runs[room].append((first, count))

    def _large(self, groups: int, parts: int) -> None:
        large = sorted((s for s in self.left if s * parts > self.capacity), reverse=True)
        total = sum(self.left[s] for s in large)
        if not total:
            return
        each = -(-total // groups)
        members: list[list[list[int]]] = [[]]  # per group [size, count], largest first
        filled = 0
        for s in large:
            n = self.left[s]
            while n:
                m = min(n, each - filled)
                members[-1].append([s, m])
                filled, n = filled + m, n - m
                if filled == each:
                    members.append([])
                    filled = 0
        members = [g for g in members if g]
        weights, demand = [g[0][0] for g in members], [sum(n for _, n in g) for g in members]
        for column, count in configurations(weights, demand, self.capacity):
            first = self.containers
            self.containers += count
            slots = [g for g, c in enumerate(column) for _ in range(c)]
            blocks = []  # per slot the (size, count) that its `count` containers get, in order
            for g in slots:
                block, need = [], count
                while need:
                    s, n = members[g][0]
                    m = min(n, need)
                    block.append((s, m))
                    need -= m
                    members[g][0][1] -= m
                    if not members[g][0][1]:
                        members[g].pop(0)
                blocks.append(block)
            ends: set[int] = set()
            for block in blocks:
                at = 0
                for s, m in block:
                    self._take(s, m, first + at)
                    at += m
                    ends.add(at)
            used = [(np.cumsum([m for _, m in b]), [s for s, _ in b]) for b in blocks]
            at = 0
            for end in sorted(ends):
                weight = sum(sizes[int(np.searchsorted(cum, at, "right"))] for cum, sizes in used)
                self._free(self.capacity - weight, first + at, end - at)
                at = end

    def _best_fit(self) -> None:
        for size in sorted(self.left, reverse=True):
            while n := self.left[size]:
                i = bisect_left(self.room, size)
                if i == len(self.room):
                    fresh = -(-n // (self.capacity // size))
                    self._free(self.capacity, self.containers, fresh)
                    self.containers += fresh
                    continue
                room = self.room[i]
                first, count = self.runs[room].pop()
                if not self.runs[room]:
                    del self.runs[room]
                    self.room.pop(i)
                m = min(n, count)
                self._take(size, m, first)
                self._free(room - size, first, m)
                self._free(room, first + m, count - m)


def best_plan(histogram: dict[int, int], capacity: int) -> Plan:
    return min((Plan(histogram, capacity, g, parts) for g, parts in TRIED), key=lambda p: p.containers)


# ---------------------------------------------------------------- documents


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, first_token, size): one piece per document, more only if it alone exceeds a container."""
    n = F.greatest(F.ceil(F.col("tokens") / F.lit(capacity)), F.lit(1)).cast("int")
    parts = counts.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    first = F.col("piece").cast("bigint") * capacity
    return parts.select("doc_id", "piece", first.alias("first_token"), F.least(F.col("tokens") - first, F.lit(capacity).cast("bigint")).alias("size"))


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items(doc_id, piece, first_token, size) with container, numbered from 0 without gaps.

    Sizes are 0 to capacity. Items of size 0 (null and empty texts) need no room and have a null container. Equal
    (doc_id, piece, size) are told apart only by order, so ids should be unique. No items: no rows.
    """
    items = cut(items)
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    empty = items.filter("size = 0").withColumn("container", F.lit(None).cast("bigint"))
    plan = best_plan({s: n for s, n in histogram.items() if s}, capacity)
    salts = max(1, -(-max(histogram.values(), default=1) // NUMBERED))
    # number items within (size, salt), then add the counts of the salts before
    salted = items.filter("size > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("size", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("__rn", F.row_number().over(own) - 1).join(offsets, ["size", "salt"])
    starts = sorted((s << 40 | a, c) for s, a, _, c in plan.ranges)
    keys, at = np.array([k for k, _ in starts], np.int64), np.array([c for _, c in starts], np.int64)
    sent = items.sparkSession.sparkContext.broadcast((keys, at))

    @F.pandas_udf("bigint")
    def container(size: pd.Series, number: pd.Series) -> pd.Series:
        k, c = sent.value
        key = (size.to_numpy(np.int64) << 40) | number.to_numpy(np.int64)
        i = np.searchsorted(k, key, "right") - 1
        return pd.Series(c[i] + key - k[i])

    placed = ranked.withColumn("container", container("size", F.col("offset") + F.col("__rn")))
    return placed.select(*items.columns, "container").unionAll(empty.select(*items.columns, "container"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts(table(spark, folder, "documents"), "doc_id", "text")
    return pack(pieces(counts, CAPACITY))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, piece, first_token, size, container) of every document."""
    return _packed(spark, folder)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """One row: containers, tokens, the least possible number of containers and the share of room that is filled."""
    per = _packed(spark, folder).filter("container is not null").groupBy("container").agg(F.sum("size").alias("used"))
    whole = per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest"))
    return whole.select("containers", "tokens", "fullest", F.ceil(F.col("tokens") / CAPACITY).alias("least"), (F.col("tokens") / (F.col("containers") * CAPACITY)).alias("filled"))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
SQL: dict[str, str] = {}
