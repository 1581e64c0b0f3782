"""A training corpus in five stages; each takes (spark, docs, sf_dir) and gives the next one's documents.

Cases, for all stages: an empty table gives an empty one; columns besides doc_id and text are carried as they are (n_chars
is counted anew where a text is cut), whatever their names; repeated rows and ties are as each stage says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlspar.llm import bpe, decontam, jaccard, rules, suffixes
from marlspar.llm.queries import tokenizer_file
from marlspar.llm.shared import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base check and the learned decision list keep.

    Null and empty texts fail the base check; rows without a doc_id are judged by their text; repeated rows alike.
    """
    return rules.keep(docs, rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), the one with the smallest doc_id.

    Texts without words have no copies; of repeated rows one stays; rows without a doc_id stay.
    """
    return jaccard.deduplicate(docs, percent=80, width=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 100-byte strings that start earlier; documents of which nothing is left go.

    Empty texts stay; repeated rows are cut alike; rows without a doc_id are not cut and cut nothing.
    """
    return suffixes.rewrite(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; null and empty texts have none."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding; a null text has none."""
    return bpe.encode(docs, tokenizer_file(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeats),
    ("decontamination", decontaminate),
    ("bpe", tokens),
]

#: Fitted lists, edit distances and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's rows are written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
