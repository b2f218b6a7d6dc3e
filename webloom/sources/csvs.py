"""CSV sources with sniffed headers, seed lists, and the failure log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.times import clamp_rank
from webloom.functions.url import host_of, normalize, seed_entry


def has_header(spark: SparkSession, path: str, marker: str) -> bool:
    """Whether the first line has the marker, in any case."""
    first = spark.read.text(path).limit(1).collect()
    return bool(first) and marker.lower() in first[0][0].lower()


def hosts(spark: SparkSession, path: str) -> DataFrame:
    """(host, centrality, state) of a file of host and rank from 0 to 10."""
    rows = spark.read.option("header", has_header(spark, path, "host")).schema("host string, rank string").csv(path)
    rows = rows.select(F.lower(F.trim("host")).alias("host"), clamp_rank(F.trim("rank")).alias("centrality"))
    return rows.filter("host <> ''").withColumn("state", F.lit(1))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(url, file, offset, length); rows without url, file or numbers are left out."""
    rows = spark.read.option("header", has_header(spark, path, "url")).option("escape", '"').schema("url string, file string, o string, l string").csv(path)
    rows = rows.select("url", "file", F.trim("o").try_cast("bigint").alias("offset"), F.trim("l").try_cast("bigint").alias("length"))
    return rows.filter("url <> '' AND file <> '' AND offset IS NOT NULL AND length IS NOT NULL")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """(url, host) of a list of hosts and URLs; blank lines and # comments are skipped, lines of no use dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' AND NOT startswith(line, '#')")
    return lines.select(normalize(seed_entry(F.col("line"))).alias("url")).filter("url IS NOT NULL").withColumn("host", host_of(F.col("url")))


def failure_lines(failures: DataFrame) -> DataFrame:
    return failures.select("url", F.replace("reason", F.lit(","), F.lit(";")).alias("reason"))


def write_failures(failures: DataFrame, path: str) -> None:
    failure_lines(failures).write.mode("append").option("header", "true").csv(path)
