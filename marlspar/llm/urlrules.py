"""URL filters as a sort-merge range join of reversed-host keys with nested rule intervals.

A host is keyed by its labels from the right, each closed by a dot (`www.example.net` -> `net.example.www.`), so
that a rule's host and all subdomains form the interval [key, key with its last dot raised to a slash). Such
intervals nest or are apart. The rules' interval bounds carry the stack of rules that are open from there on;
pages and bounds are sorted together by key, and a sweep keeps the last stack seen. Of its open rules, those
whose path starts the page's path fit, and the longest wins.

The sweep runs in many equal hash parts of the pages, each with all bounds, so no host can load one task; bounds
are never joined pairwise with pages.

Cases: a null url or one without `://` has empty host and path and fits no rule; rules of equal length: block
wins; repeated pages are judged alone; an empty page table gives no rows, an empty rule table the default
verdict; only page_id and url are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_RULE = "array<struct<length: int, verdict: string, rule: string, path: string>>"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the right, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def bounds(rules: DataFrame) -> DataFrame:
    """(key, stack): where the open rules change, and the rules open from there on.

    Rules of one host are gathered first; a host's stack adds those of its parent domains, found by equality
    on each of its suffixes.
    """
    entry = F.struct(F.length(F.concat("host", "path")).alias("length"), F.col("verdict"), F.concat("host", "path").alias("rule"), F.col("path"))
    own = rules.where("host is not null and path is not null and host <> ''").groupBy("host").agg(F.collect_set(entry).alias("own"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    chain = own.select("host", F.explode(suffixes).alias("suffix")).join(own.select(F.col("host").alias("suffix"), F.col("own").alias("part")), "suffix")
    stacks = chain.groupBy("host").agg(
        F.flatten(F.collect_list("part")).alias("inside"),
        F.flatten(F.collect_list(F.when(F.col("suffix") != F.col("host"), F.col("part")))).alias("outside"),
    )
    key = host_key(F.col("host"))
    after = F.concat(F.expr("substr(key, 1, length(key) - 1)"), F.lit("/"))
    two = F.array(F.struct(F.col("key"), F.col("inside").cast(_RULE).alias("stack")), F.struct(after.alias("key"), F.col("outside").cast(_RULE).alias("stack")))
    return stacks.withColumn("key", key).select(F.inline(two))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", sweeps: int | None = None) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every page; rules have host, path, verdict."""
    spark = pages.sparkSession
    sweeps = sweeps or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col("url").cast("string")
    left = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.pmod(F.xxhash64("page_id", "url"), F.lit(sweeps)).cast("int").alias("sweep"))
    left = left.withColumn("key", host_key(F.col("host"))).withColumn("kind", F.lit(1)).withColumn("stack", F.lit(None).cast(_RULE))
    every = F.explode(F.sequence(F.lit(0), F.lit(sweeps - 1)))
    right = bounds(rules).select(
        F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
        every.alias("sweep"), "key", F.lit(0).alias("kind"), "stack",
    )
    order = Window.partitionBy("sweep").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = left.unionByName(right).withColumn("open", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
    best = F.array_max(F.filter("open", lambda r: F.col("path").startswith(r["path"])))
    return swept.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
