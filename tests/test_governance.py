"""Patterns behind literals find what the patterns alone find."""

import functools
import random

from pyspark.sql import functions as F

from marlspar.functions import governance, vocab


def test_sensitive_texts_as_by_the_patterns_alone(spark):
    rng = random.Random(9)
    parts = ["C:/", "c:\\", "s://", "http", "https", "?", "q=1", "/home/", "/Users/", "me", "/", "sk-", "a" * 32, "KAGGLE_KEY", "OPENAI_API_KEY", " ", "=", ":", '"', "é", "\n", "x", "1"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(1500)] + ["", None]
    alone = functools.reduce(lambda a, p: a | F.coalesce("t", F.lit("")).rlike(p), vocab.SENSITIVE, F.lit(False))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", governance.is_sensitive(F.col("t")).alias("got"), alone.alias("want")).collect()
    assert [r for r in rows if r.got != r.want] == [] and 100 < sum(r.want for r in rows) < 1400


def test_a_text_is_made_once_for_all_patterns(spark):
    plan = spark.range(3).where(governance.is_sensitive(F.to_json(F.struct("id"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJson") == 1


def test_redaction_as_by_the_patterns_alone(spark):
    rng = random.Random(4)
    parts = ["SK-", "sk_", "hf-", "Hf_", "a1" * 9, "KAGGLE_key", "openai_api_key", "=", ": ", "C:\\", "dir\\", "f.txt", "/home/", "/Users/", "me/", "x", " ", "\n", "é"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(800)]

    alone = functools.reduce(lambda a, r: F.regexp_replace(a, *r), vocab.REDACT_LINES, F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", governance.redact(F.col("t"), vocab.REDACT_LINES).alias("got"), alone.alias("want")).collect()
    assert [r for r in rows if r.got != r.want] == [] and sum(r.want != r.t for r in rows) > 100
