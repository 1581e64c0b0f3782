"""Token counts from the exact length histogram.

Documents are counted by encoded length; running sums over the lengths answer, for every context limit, how many
documents fit, how many tokens there are, and how many remain when each document is cut at the limit.

Cases: null and empty texts have length 0; ties share one histogram row; an empty table has an empty histogram, of which every asked limit says 0 documents and no quantile; a limit
that is no text's length, negative ones too, has its answer from the lengths around it; repeated limits are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .shared import stored

#: Lengths of one block are summed together; blocks are then summed over, so no task sees all lengths at once.
BLOCK = 4096


def histogram(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(n_tokens, n_docs), exact."""
    rows = bpe.lengths(docs, tokenizer_path).groupBy("n_tokens").agg(F.sum("n_docs").cast("long").alias("n_docs"))
    return stored(rows, "lengths")  # read several times; the texts only once


def limits(hist: DataFrame) -> DataFrame:
    """For every length that occurs, as a context limit: documents and tokens at it, up to it and beyond it.

    truncated_tokens is the sum of min(length, limit); quantile is the share of documents no longer than it.
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    rows = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(tokens).alias("bt"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each 4,096 lengths
    sums = sums.select(
        "block", F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("bd").over(Window.partitionBy()).alias("all_docs"), F.sum("bt").over(Window.partitionBy()).alias("all_tokens"),
    )
    suffix = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, "block").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens",
        (F.coalesce(F.sum("n_docs").over(suffix), F.lit(0)) + F.col("later_docs")).alias("docs_over"),
        (F.coalesce(F.sum(tokens).over(suffix), F.lit(0)) + F.col("later_tokens")).alias("tokens_over"),
    )
    c = F.col
    return rows.select(
        c("n_tokens").alias("limit_tokens"), "n_docs", (c("all_docs") - c("docs_over")).alias("docs_within"), "docs_over", "all_tokens",
        (c("all_tokens") - c("tokens_over") + c("docs_over") * c("n_tokens")).alias("truncated_tokens"),
        F.try_divide(c("all_docs") - c("docs_over"), c("all_docs")).alias("quantile"),
    )


def at(hist: DataFrame, asked: list[int]) -> DataFrame:
    """`limits` for the given context limits, whether or not any text has such a length."""
    extra = hist.sparkSession.createDataFrame([(int(x),) for x in sorted({*asked})], "n_tokens long")
    rows = hist.select("n_tokens", "n_docs").unionByName(extra.withColumn("n_docs", F.lit(0).cast("long")))
    rows = rows.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    out = limits(rows).join(F.broadcast(extra.withColumnRenamed("n_tokens", "limit_tokens")), "limit_tokens", "left_semi")
    # a negative limit leaves nothing of any text
    return out.withColumn("truncated_tokens", F.greatest("truncated_tokens", F.lit(0)))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that this share of all documents does not exceed."""
    table = limits(hist).select("limit_tokens", "quantile")
    return table.select(*[F.min(F.when(F.col("quantile") >= q, F.col("limit_tokens"))).alias(f"q{k}") for k, q in enumerate(shares)]).select(
        F.explode(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{k}").alias("n_tokens")) for k, q in enumerate(shares)])).alias("r")
    ).select("r.*")
