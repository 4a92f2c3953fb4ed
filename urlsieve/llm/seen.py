"""Has this key been seen before? (problem 1)

Keys are sent once to their bucket by hash and pass it in order of arrival through one Golomb-coded set: probe, then
add. The earlier keys exist as compressed gaps only (about FP_BITS + 1.6 bits a key in a full bucket), nothing is kept
beside them, and the set's word is the answer, for keys known beforehand, earlier lines and lines just before alike.
A wrong answer is a new key taken for a repeat: one in 2**FP_BITS new keys of a full bucket. p1_error_rate audits it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint, refang, strip
from ..runtime import cut, parallelism, table

#: Bits of a reduced hash beyond log2 of the bucket's capacity.
FP_BITS = 32
#: The audit's settings: a coarse set that does err, and the one in use.
AUDITED_BITS = (8, FP_BITS)
#: Distinct keys a bucket is laid out for.
BUCKET_KEYS = 1 << 20
#: Rows that are looked through for hot keys at a time before the shuffle, and from how many rows a key is hot there.
CHUNK, HOT = 1 << 20, 64
#: Rows probed and added at a time.
STEP = 1 << 16


def entry_keys(df: DataFrame, id_col: str, entry: str) -> DataFrame:
    """(ord, kind, key) of published blocklist lines; kind and key are null for blank, comment and null lines (SRC-7, URL-14)."""
    s = df.select(F.col(id_col).alias("ord"), strip(F.col(entry)).alias("line"))
    s = s.select("ord", ((F.col("line") != "") & ~F.col("line").startswith("#")).alias("real"), refang(F.col("line")).alias("line"))
    s = s.select("ord", "line", F.when(F.col("real"), F.when(F.col("line").rlike("[/?]"), "url").otherwise("domain")).alias("kind"))
    url = F.regexp_replace(F.lower(F.regexp_replace(strip(refang(F.col("line"))), "(?i)^[a-z][a-z0-9+.-]*://", "")), "/+$", "")
    domain = F.regexp_replace(F.lower("line"), r"\.+$", "")
    return s.select("ord", "kind", F.when(F.col("kind") == "url", url).when(F.col("kind") == "domain", domain).alias("key"))


def _thin(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: rows without a key are dropped, and rows of a hot key behind its first row of the chunk are repeats of that one; they are marked
    `sure` and spread over all buckets. So no key sends more than HOT rows a chunk to its bucket."""

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        t = t.filter(pc.is_valid(t.column("h")))
        at, h, bucket = (t.column(c).to_numpy() for c in ("ord", "h", "bucket"))
        order = np.lexsort((at, h, bucket))
        new = (np.diff(h[order], prepend=0) != 0) | (np.diff(bucket[order], prepend=-1) != 0)
        if len(new):
            new[0] = True
        count = np.diff(np.flatnonzero(new), append=len(new))
        behind = ~new & np.repeat(count >= HOT, count)
        sure = np.zeros(len(at), bool)
        sure[order[behind]] = True
        t = t.set_column(t.schema.get_field_index("bucket"), "bucket", pa.array(np.where(sure, at % buckets, bucket), pa.int32()))
        yield from t.append_column("sure", pa.array(sure)).to_batches(max_chunksize=STEP)

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield from emit(held)
            held, rows = [], 0
    if held:
        yield from emit(held)


def _through_sets(batches: Iterator[pa.RecordBatch], bits: int, audit: bool) -> Iterator[pa.RecordBatch]:
    """Rows ordered by bucket and arrival, each bucket through its set. Without audit only the hits' ords come out."""
    from urlsieve.llm.golomb import GrowingSet, reduce_hash

    bucket, known = None, GrowingSet(bits)

    def steps() -> Iterator[pa.Table]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= STEP:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held)

    for t in steps():
        buckets, h, hit = t.column("bucket").to_numpy(), t.column("h").to_numpy(), t.column("sure").to_numpy().copy()
        rate, size = np.zeros(len(h)), np.zeros(len(h), np.int64)
        cuts = [*np.flatnonzero(np.diff(buckets, prepend=-1)), len(h)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if buckets[a] != bucket:
                bucket, known = buckets[a], GrowingSet(bits)
            i = a + np.flatnonzero(~hit[a:b])
            before = known.n
            hit[i] = known.probe_and_add(reduce_hash(h[i], bits))
            rate[i] = (before + np.cumsum(~hit[i]) - ~hit[i]) / 2.0**bits
            size[a:b] = known.size_bytes
        if audit:
            yield from t.append_column("hit", pa.array(hit)).append_column("rate", pa.array(rate)).append_column("bytes", pa.array(size)).to_batches()
        else:
            yield from t.select(["ord"]).filter(pa.array(hit)).to_batches()


def probe(keys: DataFrame, total: int, fp_bits: int = FP_BITS, extra: Sequence[str] = (), audit: bool = False) -> DataFrame:
    """keys(ord bigint, h, h2): (ord) of every row whose key has a row with a smaller ord, by the coded sets.

    Smaller ord is earlier; negative ords are known beforehand and come out as well where they repeat. Of rows with one
    key and one ord the first met is new. total: an upper bound of the rows. Null hashes (both) are no keys. Empty keys:
    no rows. With audit: every row as (ord, h, bucket, *extra, sure, hit, rate, bytes), rate being the theoretical one of
    the set and bytes its size when the row passed; rows marked sure are repeats that never reached a set.
    """
    spark = keys.sparkSession
    buckets = max(parallelism(spark), -(-total // BUCKET_KEYS))
    bits = int(np.ceil(np.log2(max(2, min(BUCKET_KEYS, 2 * -(-total // buckets)))))) + fp_bits
    rows = keys.select("ord", "h", F.pmod("h2", F.lit(buckets)).cast("int").alias("bucket"), *extra)
    schema = "ord bigint, h bigint, bucket int, " + "".join(f"{c} {keys.schema[c].dataType.simpleString()}, " for c in extra) + "sure boolean"
    sent = rows.mapInArrow(lambda b: _thin(b, buckets), schema)
    ordered = sent.repartition(min(buckets, 4 * parallelism(spark)), "bucket").sortWithinPartitions("bucket", "ord", "h")
    out = schema + ", hit boolean, rate double, bytes bigint" if audit else "ord bigint"
    return ordered.mapInArrow(lambda b: _through_sets(b, bits, audit), out)


def feed_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(ord, h, h2) of the seed (ord -1) and of the feed's lines; hashes are null for lines without a key.

    No filter here: Spark would carry it down to the scan and work out every key once more for it."""
    feed = entry_keys(table(spark, folder, "blocklist_feed"), "entry_id", "entry")
    seed = table(spark, folder, "blocklist_seed").select(F.lit(-1).cast("bigint").alias("ord"), "kind", F.col("entry_key").alias("key"))
    h, h2 = fingerprint("kind", "key")
    known = F.col("kind").isNotNull() & F.col("key").isNotNull()
    return feed.unionAll(seed).select("ord", F.when(known, h).alias("h"), F.when(known, h2).alias("h2"))


def _rows(spark: SparkSession, folder: str) -> int:
    return table(spark, folder, "blocklist_feed").count() + table(spark, folder, "blocklist_seed").count()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """entry_id of every line whose kind and key are in the seed or on a line with a smaller entry_id."""
    return probe(feed_keys(spark, folder), _rows(spark, folder)).filter("ord >= 0").select(F.col("ord").alias("entry_id"))


def audited(keys: DataFrame, total: int, fp_bits: int) -> DataFrame:
    """One row: fp_bits, lines, hits, hits without the sets (`sure`), false positives by comparison with all earlier
    keys, their rate among new keys, the theoretical rate, distinct keys kept and bits a key."""
    states = cut(probe(keys, total, fp_bits, ["h2"], audit=True))
    lines = states.filter("ord >= 0")
    one = lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if("hit").alias("hits"), F.count_if("sure").alias("sure"), F.avg(F.when(~F.col("hit"), F.col("rate"))).alias("theoretical_rate"))
    first = keys.filter("h is not null").groupBy("h", "h2").agg(F.min("ord").alias("ord"))
    wrong = lines.filter("hit and not sure").join(first, ["ord", "h", "h2"], "left_semi").agg(F.count(F.lit(1)).alias("false_positives"))
    kept = states.agg(F.count_if(~F.col("hit")).alias("kept"))
    size = states.groupBy("bucket").agg(F.max("bytes").alias("b")).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("filter_bytes"))
    fp = F.col("false_positives")
    return (
        one.crossJoin(wrong)
        .crossJoin(kept)
        .crossJoin(size)  # one-row aggregates
        .select(
            F.lit(fp_bits).alias("fp_bits"),
            "lines",
            "hits",
            "sure",
            fp,
            (fp / F.greatest(F.col("lines") - F.col("hits") + fp, F.lit(1))).alias("audited_rate"),
            "theoretical_rate",
            "kept",
            (8 * F.col("filter_bytes") / F.greatest(F.col("kept"), F.lit(1))).alias("bits_per_key"),
        )
    )


def p1_error_rate(spark: SparkSession, folder: str) -> DataFrame:
    """The theoretical and the audited rate of wrong answers, one row a setting of AUDITED_BITS (see audited)."""
    keys, total = cut(feed_keys(spark, folder)), _rows(spark, folder)
    coarse, fine = (audited(keys, total, bits) for bits in AUDITED_BITS)
    return coarse.unionAll(fine)


QUERIES = {"p1_found": p1_found, "p1_error_rate": p1_error_rate}

SQL = {
    "p1_found": r"""
        WITH l AS (SELECT entry_id, regexp_replace(entry, '^[\t-\r\x1c-\x1f \x{85}\x{a0}]+|[\t-\r\x1c-\x1f \x{85}\x{a0}]+$', '', 'g') AS s FROM blocklist_feed),
        f AS (SELECT entry_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(
                regexp_replace(s, '^hxxp', 'http', 'i'), '[://]', '://'), '[:]', ':'), '[.]', '.'), '(.)', '.'), '{.}', '.'), '[/]', '/'), '[@]', '@'),
                '\[dot\]|\(dot\)', '.', 'gi') AS s
              FROM l WHERE s <> '' AND NOT starts_with(s, '#')),
        k AS (SELECT entry_id, CASE WHEN regexp_matches(s, '[/?]') THEN 'url' ELSE 'domain' END AS kind,
                CASE WHEN regexp_matches(s, '[/?]') THEN rtrim(lower(regexp_replace(s, '^[a-z][a-z0-9+.-]*://', '', 'i')), '/')
                     ELSE rtrim(lower(s), '.') END AS key FROM f)
        SELECT entry_id FROM k
        WHERE EXISTS (SELECT 1 FROM blocklist_seed b WHERE b.kind = k.kind AND b.entry_key = k.key)
           OR entry_id > (SELECT min(o.entry_id) FROM k o WHERE o.kind = k.kind AND o.key = k.key)
    """,
}
