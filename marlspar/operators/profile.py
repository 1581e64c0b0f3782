"""Dataset profiling: column statistics, schema signals, modalities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab

# --- fixed values ---
ID_NAMES = ["id", "uuid", "key", "index"]
GROUP_NAMES = ["user", "customer", "patient", "subject", "session", "group", "household", "speaker", "recording", "scene", "study"]
TIME_NAMES = ["time", "date", "timestamp", "year", "month", "day", "hour"]
MODALITY_SUFFIXES = {
    "image": ".png .jpg .jpeg .bmp .tif .tiff .webp .dcm .dicom",
    "audio": ".wav .mp3 .flac .ogg .m4a",
    "text": ".txt .md .json .jsonl",
    "tabular": ".csv .tsv .parquet .feather",
    "archive": ".zip .tar .gz .7z",
}
# --- end of fixed values ---


def columns(df: DataFrame, rows: int | None = None) -> DataFrame:
    """(column, n_rows, n_missing, n_unique, missing_fraction, unique_fraction) in one aggregation.

    A value is missing if null or, stripped and lower-cased, one of the NA tokens. Distinct values are counted
    exactly, over the values that are not missing. `rows` profiles the first rows only, as a stated sample.
    """
    if rows is not None:
        df = df.limit(rows)
    aggs, parts = [F.count(F.lit(1)).alias("n")], []
    for k, c in enumerate(df.columns):
        v = F.col(f"`{c}`").cast("string")
        missing = v.isNull() | F.lower(F.trim(v)).isin(vocab.NA_TOKENS)
        aggs += [F.count_if(missing).alias(f"m{k}"), F.count_distinct(F.when(~missing, v)).alias(f"u{k}")]
        parts.append(F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"m{k}").alias("n_missing"), F.col(f"u{k}").alias("n_unique")))
    out = df.agg(*aggs).select(F.inline(F.array(*parts)))
    share = lambda c: F.round(F.col(c) / F.greatest("n_rows", F.lit(1)), 4)
    return out.withColumn("missing_fraction", share("n_missing")).withColumn("unique_fraction", share("n_unique"))


def named(columns_: list[str], patterns: list[str]) -> list[str]:
    return [c for c in columns_ if any(p in c.lower() for p in patterns)]


def schema_signals(train: list[str], test: list[str], sample: list[str]) -> dict[str, list[str]]:
    """Set algebra over column names: targets are train columns the test lacks, or sample columns the test lacks."""
    t, s, x = set(test), set(sample), set(train)
    whole = list(dict.fromkeys([*train, *test]))
    return {
        "target_candidates": sorted((x - t) | (s - t)) if test else sorted(s - t),
        "id_candidates": named(whole, ID_NAMES),
        "group_candidates": named(whole, GROUP_NAMES),
        "time_candidates": named(whole, TIME_NAMES),
        "train_only": sorted(x - t),
        "test_only": sorted(t - x),
    }


def modalities(suffixes: list[str]) -> list[str]:
    return [name for name, have in MODALITY_SUFFIXES.items() if {s.lower() for s in suffixes} & set(have.split())]


def describe(tables: DataFrame) -> DataFrame:
    """(table, description): one line of a table's columns and missing shares."""
    part = F.when(F.col("missing_fraction") > 0, F.format_string("%s (%.4f missing)", "column", "missing_fraction")).otherwise(F.col("column"))
    return tables.groupBy("table").agg(F.array_join(F.array_sort(F.collect_list(part)), "; ").alias("description"))
