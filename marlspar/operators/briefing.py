"""What to read first of retrieval results, comparison of runs, and checks of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab


def is_direct(level: Column) -> Column:
    return level.isin(vocab.DIRECT_LEVELS)


def reading_manifest(results: DataFrame, key: str, must: int = 3, support: int = 5) -> DataFrame:
    """(key, must_read, support): anchors to read in full, from results (key, position, anchor, match_level, reasons,
    code_evidence_count, source_type).

    The first direct anchors must be read; support comes from results with a risk, then with code, then from writeups,
    without those. Null and empty anchors count nowhere; a key without anchors has no row. Each list is cut by a ranked
    window over one row an anchor, so that a key may have any number of results.
    """
    c = F.col
    risk = F.exists("reasons", lambda r: r.startswith("risk:"))
    parts = [risk, c("code_evidence_count") > 0, F.lower("source_type").contains("writeup")]
    places = [F.min(F.when(p, c("position"))) for p in parts]
    first = F.coalesce(*[F.when(p.isNotNull(), F.struct(F.lit(k).alias("part"), p.alias("at"))) for k, p in enumerate(places)])
    seen = results.where("anchor <> ''").groupBy(key, "anchor").agg(F.min(F.when(is_direct(c("match_level")), c("position"))).alias("direct"), first.alias("other"))

    def top(by: str, most: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(by))
        return seen.where(c(by).isNotNull()).withColumn("n", rank).where(c("n") <= most).select(key, "anchor", "n", F.lit(by).alias("list"))

    few = top("direct", must).unionByName(top("other", support))  # must + support rows a key

    def listed(by: str) -> Column:
        return F.array_sort(F.collect_list(F.when(c("list") == by, F.struct("n", "anchor"))))["anchor"]

    lists = few.groupBy(key).agg(listed("direct").alias("must_read"), listed("other").alias("support"))
    return lists.select(key, "must_read", F.array_except("support", "must_read").alias("support"))


def match_ratios(results: DataFrame, key: str) -> DataFrame:
    """(key, direct_ratio, source_link_ratio) of results (key, match_level, linked)."""
    share = [F.avg(F.coalesce(x, F.lit(False)).cast("int")) for x in (is_direct(F.col("match_level")), F.col("linked"))]
    return results.groupBy(key).agg(share[0].alias("direct_ratio"), share[1].alias("source_link_ratio"))


def compare(runs: DataFrame, pairs: DataFrame, key: str, values: list[str], carried: list[str], kept: list[str]) -> DataFrame:
    """Each pair (parent_id, child_id) with child - parent of `values`, the child's `carried` and both runs' `kept`.

    A value that either run lacks gives null. Pairs with an unknown run have `known` false and nulls.
    """
    columns = [*dict.fromkeys([*values, *carried, *kept])]
    sides = [runs.select(F.col(key).alias(f"{s}_id"), F.lit(True).alias(f"_{s}"), *(F.col(x).alias(f"{s}_{x}") for x in columns)) for s in ("parent", "child")]
    both = pairs.join(sides[0], "parent_id", "left").join(sides[1], "child_id", "left")
    out = [F.coalesce(F.col("_parent") & F.col("_child"), F.lit(False)).alias("known")]
    out += [(F.col(f"child_{x}") - F.col(f"parent_{x}")).alias(f"{x}_delta") for x in values] + [F.col(f"child_{x}").alias(x) for x in carried]
    return both.select("parent_id", "child_id", *out, *(f"{s}_{x}" for x in kept for s in ("parent", "child")))


def unverified(references: DataFrame, tasks: DataFrame, key: str) -> DataFrame:
    """References whose task is unknown or not verified, with the problem; none means that all may be used."""
    status = tasks.select(key, F.lit(True).alias("_known"), "status")
    rows = references.join(status, key, "left").where("_known is null or not (status <=> 'verified')")
    return rows.withColumn("problem", F.when(F.col("_known").isNull(), "unknown").otherwise("not verified")).drop("_known", "status")


def suffix(name: Column) -> Column:
    """The lower-case last suffix of a file name; empty for names without one, that start with their only dot, or end in a dot."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def language(name: Column) -> Column:
    """The language of a file by its suffix, else `text`."""
    known = F.create_map(*[F.lit(x) for pair in vocab.LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix(name)), F.lit("text"))


def suffix_counts(files: DataFrame, name: str) -> DataFrame:
    """(suffix, n) of all file names; `<none>` stands for no suffix."""
    own = suffix(F.col(name))
    return files.groupBy(F.when(own == "", "<none>").otherwise(own).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


def collected_score(writeups: Column, evidence: Column, tricks: Column, commit: Column, spdx: Column) -> Column:
    """Quality of a collected source: every kind of support adds up to its own bound, 80 in all at most; only the licence `unknown` gives no points."""
    bounded = [F.least(F.lit(15), 5 * writeups), F.least(F.lit(30), 4 * evidence), F.least(F.lit(10), 2 * tricks)]
    flags = [F.when(commit != "", 3).otherwise(0), F.when(~spdx.eqNullSafe("unknown"), 2).otherwise(0)]
    return F.least(F.lit(80), sum([*bounded, *flags], F.lit(20)))
