"""Filter interaction audit: how five quality filters overlap, and what every order of them removes.

Words are exploded into a relation (row, word), aggregated to (row, word) and then to the row for totals and distinct
words; this runs on Arrow tables inside the scan, where all words of a row are, so no word is shuffled. The other flags are outer-joined:
the smallest doc_id of an equal text by (doc_id, digest), the labels by doc_id. A set of failed filters is a mask of five bits;
each part is aggregated to 32 conditional counts, from which the answers for all 120 orders follow by arithmetic.

Cases: a null text is empty; a null source is the part ''; repeated rows count once each and are not copies of one another;
a row without a doc_id is no copy and makes no other row one, and has no label; of several labels for one doc_id, 1 wins; an empty
table gives an empty result; columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import prepare, stored

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Bytes of text whose words are a relation at a time; a longer text is one of its own.
SLICE_BYTES = 4 << 20


def _words(texts: pa.Array) -> tuple[list[int], list[int]]:
    """Words and distinct words of each text: (row, word) pairs, aggregated by pair, then by row."""
    split = pc.split_pattern_regex(texts, pattern="[ \\t-\\r]+")
    pairs = pa.table({"row": pc.list_parent_indices(split), "word": pc.list_flatten(split)})
    pairs = pairs.filter(pc.not_equal(pairs["word"], ""))
    by_word = pairs.group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")])
    by_row = by_word.group_by("row", use_threads=False).aggregate([("count_all", "sum"), ([], "count_all")])
    total, distinct = [0] * len(texts), [0] * len(texts)
    for row, n, d in zip(by_row["row"].to_pylist(), by_row["count_all_sum"].to_pylist(), by_row["count_all"].to_pylist(), strict=True):
        total[row], distinct[row] = n, d
    return total, distinct


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_string())
        sizes = pc.binary_length(texts).to_pylist()
        lo = 0
        while lo < len(texts):
            hi, size = lo + 1, sizes[lo]
            while hi < len(texts) and size + sizes[hi] <= SLICE_BYTES:
                size += sizes[hi]
                hi += 1
            part = texts.slice(lo, hi - lo)
            total, distinct = _words(part)
            upper = pc.count_substring_regex(part, pattern="[A-Z]").to_pylist()
            points = pc.utf8_length(part).to_pylist()
            symbol = pc.match_substring_regex(part, pattern="[#$%&*|]").to_pylist()
            mask = [
                (n < 200) | (100 * d < 50 * n) << 1 | (100 * u > 2 * c) << 2 | s << 3
                for n, d, u, c, s in zip(total, distinct, upper, points, symbol, strict=True)
            ]
            columns = [batch.column(k).slice(lo, hi - lo) for k in ("doc_id", "part", "digest")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(mask, pa.int32())], ["doc_id", "part", "digest", "mask"])
            lo = hi


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents of one part by failed filters (bit k: FILTERS[k]) and labels."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    facts = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).mapInArrow(_facts, "doc_id long, part string, digest binary, mask int")
    # repeated rows are one row with a number from here on
    facts = stored(facts.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "facts")
    # joined by id and digest: copies of one text, however many, are different keys
    first = facts.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    out = facts.join(first, ["doc_id", "digest"], "left").join(marks.where(F.col("doc_id").isNotNull()), "doc_id", "left")
    mask = F.col("mask").bitwiseOR(F.when(copy, 1 << 4).otherwise(0))
    return out.select("part", mask.alias("mask"), (F.coalesce("good", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"), "n")


def cube(rows: DataFrame) -> DataFrame:
    """One row a part: arrays of 32 conditional counts of all documents, of those labelled good and of toxic ones."""

    def counts(also: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when((F.col("mask") == m) & also, F.col("n"))), F.lit(0)) for m in range(MASKS)])

    return rows.groupBy("part").agg(counts(F.lit(True)).alias("docs"), counts(F.col("good")).alias("good"), counts(F.col("toxic")).alias("toxic"))


def _over(counts: str, test) -> Column:
    """Sum of the counts whose mask meets a condition; mask numbers are 0 to 31."""
    return F.aggregate(F.filter(F.transform(counts, lambda c, m: F.when(test(m), c)), lambda c: c.isNotNull()), F.lit(0).cast("long"), lambda a, c: a + c)


def orders(counts: DataFrame) -> DataFrame:
    """Every part, order of the filters and step with what the step keeps, removes and shares."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            steps.append(f"{''.join(order)} {step} {bit} {before}")
            before |= bit
    said = F.transform(F.split(F.lit(";".join(steps)), ";"), lambda x: F.split(x, " "))
    rows = counts.select("part", "docs", "good", "toxic", F.explode(said).alias("s")).select(
        "part", "docs", "good", "toxic", F.col("s")[0].alias("filter_order"), F.col("s")[1].cast("int").alias("step"), F.col("s")[2].cast("int").alias("bit"), F.col("s")[3].cast("int").alias("before")
    )
    bit, before = F.col("bit"), F.col("before")

    def removed(m):
        return (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)

    # a filter is the first of a mask's k failing ones in 1 / k of all orders
    share = F.transform("docs", lambda c, m: F.when(m.bitwiseAND(bit) != 0, c * F.floor(F.lit(120) / F.bit_count(m))).otherwise(0))
    return rows.select(
        "part", "filter_order", "step",
        _over("docs", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        _over("docs", removed).alias("removed"),
        _over("docs", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        _over("docs", lambda m: m == bit).alias("unique_fails"),
        _over("good", removed).alias("good_lost"), _over("toxic", removed).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, c: a + c).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all documents, one row for each part, order and step."""
    return orders(cube(masks(docs, labels)))
