"""Text sources: URL lists, domain lists, block lists, labelled pairs. Each gives a DataFrame."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import refang, strip
from ..functions.urls import canonical_key

#: Fixed value: everything that str.splitlines() ends a line at.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def first_occurrences(lines: DataFrame) -> DataFrame:
    """lines(ord, url): stripped, without blanks and comments, each URL once at its first place (ST-4)."""
    clean = lines.select("ord", strip(F.col("url")).alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))
    return clean.groupBy("url").agg(F.min("ord").alias("ord")).select("ord", "url")


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1, SRC-2: (ord, url) of a URL list file, '-' for standard input. ord grows with the place in the file.

    The file is read in splits of lines, and each line is cut at the line ends that Spark's reader doesn't know.
    """
    if path == "-":
        return from_lines(spark, sys.stdin.read().splitlines())
    lines = spark.read.text(path).select(F.explode(F.split("value", LINE_ENDS)).alias("url"))
    return first_occurrences(lines.select(F.monotonically_increasing_id().alias("ord"), "url"))


read_urls_from_file = read_urls


def from_lines(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    return first_occurrences(spark.createDataFrame(list(enumerate(lines)), "ord int, url string"))


def from_arguments(spark: SparkSession, urls: Iterable[str]) -> DataFrame:
    """SRC-3: (ord, url) of URLs given one by one; comments aren't filtered."""
    given = spark.createDataFrame(list(enumerate(urls)), "ord int, url string").select("ord", strip(F.col("url")).alias("url")).filter("url <> ''")
    return given.groupBy("url").agg(F.min("ord").alias("ord")).select("ord", "url")


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: (domain) of 'domain' or 'rank,domain' lines, distinct."""
    s = spark.read.text(path).select(strip(F.col("value")).alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    token = F.regexp_replace(F.lower(strip(F.element_at(F.split("line", ","), -1))), "^[a-z][a-z0-9+.-]*://", "")
    return s.select(F.regexp_replace(F.substring_index(token, "/", 1), r"\.+$", "").alias("domain")).filter("domain <> ''").distinct()


def split_blocklist(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-7: lines(line) as (key) of URLs and (domain) of domains, both distinct. Null lines are passed over."""
    s = lines.select(strip(F.col("line")).alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#")).select(refang(F.col("line")).alias("line"))
    is_url = F.col("line").rlike("[/?]")
    urls = s.filter(is_url).select(canonical_key(F.col("line")).alias("key")).distinct()
    domains = s.filter(~is_url).select(F.rtrim(F.lower("line"), F.lit(".")).alias("domain")).distinct()
    return urls, domains


def read_blocklist(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return split_blocklist(spark.read.text(path).select(F.col("value").alias("line")))


def read_labelled(spark: SparkSession, good: str, bad: str) -> tuple[DataFrame, DataFrame]:
    """SRC-10: both lists, each without repetitions of its own."""
    return read_urls(spark, good), read_urls(spark, bad)
