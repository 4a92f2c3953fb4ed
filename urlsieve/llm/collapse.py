"""Duplicates hidden by formatting (problem 5).

A URL's canonical text is built by Catalyst expressions and hashed to 128 bits. Each partition builds two Bloom
filters over its hashes, of those seen and of those seen again; merging ORs them and adds to the second what both
sides may have seen, then folds it as small as its few bits allow. Only rows that the second filter lets through are shuffled and grouped exactly; all other rows
are singletons, with no false decision, as a Bloom filter has no false negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DEFANG_PAIRS, fingerprint, undo_pairs
from ..operators.skew import HOT_ROWS, salted_join
from ..runtime import cut, table

#: Filter bits a key and bits set a key: about 0.25 % of singletons pass.
BITS_PER_KEY = 16
HASHES = 4
#: Keys a filter shard is laid out for; a shard is 2 MB.
SHARD_KEYS = 1 << 20
SHARD_BITS = SHARD_KEYS * BITS_PER_KEY
#: Largest filter that is sent to executors at a time; more shards go in further passes over their rows.
MAX_FILTER_BYTES = 64 << 20
#: The filter of repeats is folded in half while at most this share of its bits is set: 0.2 ** HASHES pass wrongly.
FULL = 0.2

_OPEN = r"""^(?:['"`<({,;.!]|\[(?![0-9a-f:.]+\]))+"""
_CLOSE = r"""(?:['"`>)},;.!?#&/]|(?<!\[[0-9a-f:.]{2,60})\])+$"""


def canonical_url(df: DataFrame, id_col: str, url: str) -> DataFrame:
    """(id, text): one text for all writings of a URL; null for null and for nothing but blanks and marks.

    Undone: letter case, ASCII white space, marks around, defanging, a missing scheme (http), order of parameters,
    doubled, trailing and empty separators. Kept: scheme, port, host, segments, parameters with their number,
    fragment, every other mark, every non-ASCII character. Stages are separate projections, so that no expression is
    evaluated once per use.
    """
    scheme = r"^[a-z][a-z0-9+.\-]*://"
    s = df.select(F.col(id_col).alias("id"), F.regexp_replace(F.lower(url), r"[\t\n\x0b\f\r ]+", "").alias("u"))
    s = s.withColumn("u", F.regexp_replace(F.regexp_replace(F.regexp_replace(undo_pairs(F.col("u")), _OPEN, ""), _CLOSE, ""), "^hxxp", "http"))
    s = s.withColumn("has", F.col("u").rlike(scheme))
    s = s.select("id", "u", F.when(F.col("has"), F.substring_index("u", "://", 1)).otherwise("http").alias("scheme"), F.when(F.col("has"), F.regexp_replace("u", scheme, "")).otherwise(F.regexp_replace("u", "^/+", "")).alias("rest"))
    s = s.select("id", "u", "scheme", F.substring_index("rest", "#", 1).alias("before"), F.regexp_replace(F.regexp_extract("rest", "(?s)#+(.*)$", 1), "#+", "#").alias("fragment"))
    s = s.select("id", "u", "scheme", "fragment", F.substring_index("before", "?", 1).alias("main"), F.split(F.regexp_extract("before", r"(?s)\?+(.*)$", 1), "&").alias("params"))
    query = F.array_join(F.array_sort(F.filter("params", lambda p: p != "")), "&")
    host = F.regexp_replace(F.regexp_replace(F.substring_index("main", "/", 1), r"\.{2,}", "."), r"^\.+|\.+(?=:[0-9]*$)|[.:]+$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract("main", "(?s)/(.*)$", 1), "/{2,}", "/"), "^/+|/+$", "")
    return s.select("id", F.when(F.col("u") != "", F.concat_ws("\x01", "scheme", host, path, query, "fragment")).alias("text"))


# ---------------------------------------------------------------- Bloom filters


def positions(h: np.ndarray) -> np.ndarray:
    """(len(h), HASHES) bit positions within a shard, by double hashing."""
    u = h.astype(np.int64).view(np.uint64)
    a, b = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(SHARD_BITS)).astype(np.int64)


def shard_of(h2: np.ndarray, shards: int) -> np.ndarray:
    return np.mod(h2.astype(np.int64), shards)  # pmod() of Catalyst


def _as_bytes(bits: np.ndarray) -> bytes:
    """Set positions, sorted: as deltas where that is shorter than the bitmap."""
    import zlib

    if 4 * len(bits) < SHARD_BITS // 8:
        return b"s" + zlib.compress(np.diff(bits, prepend=0).astype(np.uint32).tobytes(), 1)
    full = np.zeros(SHARD_BITS, np.uint8)
    full[bits] = 1
    return b"b" + np.packbits(full).tobytes()


def _to_bitmap(data: bytes) -> np.ndarray:
    import zlib

    if data[:1] == b"b":
        return np.frombuffer(data, np.uint8, offset=1).copy()
    full = np.zeros(SHARD_BITS, np.uint8)
    full[np.cumsum(np.frombuffer(zlib.decompress(data[1:]), np.uint32).astype(np.int64))] = 1
    return np.packbits(full)


FILTERS = "shard int, once binary, again binary"


def _build(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, h2 = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for batch in batches:  # 16 bytes a row of the partition
            h.append(batch.column(0).to_numpy())
            h2.append(batch.column(1).to_numpy())
        h, h2 = np.concatenate(h), np.concatenate(h2)
        shard = shard_of(h2, shards)
        for s in np.unique(shard):
            values, n = np.unique(h[shard == s], return_counts=True)
            once = np.unique(positions(values))
            again = np.unique(positions(values[n > 1]))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([_as_bytes(once)]), pa.array([_as_bytes(again)])], names=["shard", "once", "again"])

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    once = np.zeros(SHARD_BITS // 8, np.uint8)
    again = np.zeros(SHARD_BITS // 8, np.uint8)
    for o, a in zip(pdf["once"], pdf["again"]):
        o = _to_bitmap(o)
        again |= _to_bitmap(a) | (once & o)
        once |= o
    as_set = lambda m: _as_bytes(np.flatnonzero(np.unpackbits(m)))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "once": [as_set(once)], "again": [as_set(again)]})


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """The filter of repeats of a shard, as short as FULL allows."""
    bits = _to_bitmap(_merge(pdf)["again"].iloc[0])
    ones = int(np.bitwise_count(bits).sum())
    while len(bits) > 64 and 2 * ones <= FULL * 8 * len(bits):
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
        ones = int(np.bitwise_count(bits).sum())
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "again": [bits.tobytes()]})


def repeat_filters(keys: DataFrame, shards: int) -> Iterator[tuple[int, int, dict[int, bytes]]]:
    """Filters of the hashes of keys(h, h2) seen more than once, as (first shard, behind the last one, shard -> bitmap),
    each with at most MAX_FILTER_BYTES (or one shard). Every shard lies in one of them."""
    parts = keys.select("h", "h2").mapInArrow(_build(shards), FILTERS)
    width = 32  # partitions merged in one task; the second step has partitions / 32 a shard
    step = parts.withColumn("to", F.pmod(F.spark_partition_id(), F.lit(width))).groupBy("shard", "to").applyInPandas(lambda p: _merge(p), FILTERS)
    done = cut(step.groupBy("shard").applyInPandas(lambda p: _fold(p), "shard int, again binary"))
    first, held, size = 0, {}, 0
    for r in done.orderBy("shard").toLocalIterator():
        if held and size + len(r.again) > MAX_FILTER_BYTES:
            yield first, r.shard, held
            first, held, size = r.shard, {}, 0
        held[r.shard] = bytes(r.again)
        size += len(r.again)
    yield first, shards, held


def _prober(sent: Broadcast, shards: int):
    @F.pandas_udf("boolean")
    def may_repeat(h: pd.Series, h2: pd.Series) -> pd.Series:
        values, shard = h.to_numpy(np.int64), shard_of(h2.to_numpy(np.int64), shards)
        out = np.zeros(len(values), bool)
        for s in np.unique(shard):
            if s in sent.value:
                bits = np.frombuffer(sent.value[s], np.uint8)
                at = np.flatnonzero(shard == s)
                p = positions(values[at]) & (8 * len(bits) - 1)
                out[at] = ((bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=1)
        return pd.Series(out)

    return may_repeat


def flagged(keys: DataFrame, total: int) -> DataFrame:
    """keys(.., h, h2) with `maybe`: whether the hash may occur more than once, by the merged filters.

    A row is probed once, in the pass that holds the filter of its shard.
    """
    shards = max(1, -(-total // SHARD_KEYS))
    out = None
    for first, end, filters in repeat_filters(keys, shards):
        may_repeat = _prober(keys.sparkSession.sparkContext.broadcast(filters), shards)
        mine = F.pmod("h2", F.lit(shards))
        rows = keys if (first, end) == (0, shards) else keys.filter((mine >= first) & (mine < end))
        marked = rows.withColumn("maybe", may_repeat("h", "h2"))
        out = marked if out is None else out.unionAll(marked)
    return out


# ---------------------------------------------------------------- operator


def keyed(texts: DataFrame) -> DataFrame:
    """texts(id, text) as (id, h, h2), written once; both hashes are null for null text."""
    h, h2 = fingerprint("text")
    known = F.col("text").isNotNull()
    return cut(texts.select("id", F.when(known, h).alias("h"), F.when(known, h2).alias("h2")))


def _counted(maybe: DataFrame) -> DataFrame:
    return maybe.groupBy("h", "h2").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


def members(keys: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keep_id, copy_id) for keyed() rows: each member of a group but the one with the smallest id."""
    known = keys.filter("h is not null")
    maybe = cut(flagged(known, known.count()).filter("maybe").select("id", "h", "h2"))
    joined = salted_join(maybe, _counted(maybe).filter("copies > 1"), ["h", "h2"], "copies", hot_rows)
    return joined.filter("id > keep_id").select("keep_id", F.col("id").alias("copy_id"))


def collapse(texts: DataFrame) -> DataFrame:
    """texts(id, text) as (keep_id, copies): one row per distinct text, with the smallest id and the number of rows.

    Rows that the filter calls singletons are emitted as they are read, without a shuffle; so are rows with null text,
    each of which stands alone. No input rows: no rows.
    """
    keys = keyed(texts)
    known = keys.filter("h is not null")
    marked = cut(flagged(known, known.count()).select("id", "h", "h2", "maybe"))
    one = F.lit(1).cast("bigint").alias("copies")
    alone = keys.filter("h is null").select("id").unionAll(marked.filter("not maybe").select("id"))
    return alone.select(F.col("id").alias("keep_id"), one).unionAll(_counted(marked.filter("maybe")).select("keep_id", "copies"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(keep_id, copy_id): rows of results whose url is the same but for formatting."""
    return members(keyed(canonical_url(table(spark, folder, "results"), "result_id", "url")))


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """(keep_id, copies): one row per URL of results.url."""
    return collapse(canonical_url(table(spark, folder, "results"), "result_id", "url"))


def p5_normalized_records(spark: SparkSession, folder: str) -> DataFrame:
    """(keep_id, copies): one row per URL of results.normalized_url."""
    return collapse(canonical_url(table(spark, folder, "results"), "result_id", "normalized_url"))


QUERIES = {"p5_found": p5_found, "p5_records": p5_records, "p5_normalized_records": p5_normalized_records}


def _undone(x: str) -> str:
    for old, new in DEFANG_PAIRS:
        x = f"replace({x}, '{old}', '{new}')"
    return rf"regexp_replace({x}, '\[dot\]|\(dot\)', '.', 'g')"


def _canonical(column: str) -> str:
    """CTE k(result_id, t): canonical_url() of a column. The square brackets of an address are set aside while marks go."""
    return rf"""
        a AS (SELECT result_id, regexp_replace({_undone(rf"regexp_replace(lower({column}), '[\t\n\x0b\f\r ]+', '', 'g')")}, '\[([0-9a-f:.]+)\]', chr(2) || '\1' || chr(3), 'g') AS u FROM results),
        b AS (SELECT result_id, regexp_replace(regexp_replace(u, '^[''"`<(\[{{,;.!]+', ''), '[''"`>)\]}},;.!?#&/]+$', '') AS u FROM a),
        c AS (SELECT result_id, regexp_replace(replace(replace(u, chr(2), '['), chr(3), ']'), '^hxxp', 'http') AS u FROM b),
        d AS (SELECT *, regexp_matches(u, '^[a-z][a-z0-9+.-]*://') AS has FROM c),
        e AS (SELECT result_id, u, CASE WHEN has THEN split_part(u, '://', 1) ELSE 'http' END AS scheme, CASE WHEN has THEN regexp_replace(u, '^[a-z][a-z0-9+.-]*://', '') ELSE ltrim(u, '/') END AS r FROM d),
        f AS (SELECT *, split_part(r, '#', 1) AS w, regexp_replace(regexp_extract(r, '(?s)#+(.*)$', 1), '#+', '#', 'g') AS fragment FROM e),
        g AS (SELECT *, split_part(w, '?', 1) AS m, array_to_string(list_sort(list_filter(string_split(regexp_extract(w, '(?s)\?+(.*)$', 1), '&'), lambda p: p <> '')), '&') AS query FROM f),
        h AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(m, '/', 1), '\.{{2,}}', '.', 'g'), '^\.+', ''), '\.+(:[0-9]*)$', '\1'), '[.:]+$', '') AS host,
                     trim(regexp_replace(regexp_extract(m, '(?s)/(.*)$', 1), '/+', '/', 'g'), '/') AS path FROM g),
        k AS (SELECT result_id, CASE WHEN u <> '' THEN concat_ws(chr(1), scheme, host, path, query, fragment) END AS t FROM h)"""


_RECORDS = "WITH {0} SELECT min(result_id) AS keep_id, count(*)::BIGINT AS copies FROM k WHERE t IS NOT NULL GROUP BY t UNION ALL SELECT result_id, 1 FROM k WHERE t IS NULL"
SQL = {
    "p5_found": f"""WITH {_canonical("url")}, m AS (SELECT min(result_id) OVER (PARTITION BY t) AS keep_id, result_id AS copy_id FROM k WHERE t IS NOT NULL)
        SELECT keep_id, copy_id FROM m WHERE keep_id < copy_id""",
    "p5_records": _RECORDS.format(_canonical("url")),
    "p5_normalized_records": _RECORDS.format(_canonical("normalized_url")),
}
