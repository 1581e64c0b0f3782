"""File sources: listings, headers of images, audio and archives, text assets, notebooks, books, ledgers."""

from __future__ import annotations

import io
import json
import wave
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import governance


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, file, suffix, size_bytes, role) of all files below root; parts that start with a dot are skipped.

    Only the listing is read: the content column is pruned. Order: train, test, then larger first.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size_bytes"))
    df = df.withColumn("file", F.element_at(F.split("path", "/"), -1)).where(~F.expr("substr(path, length('" + root.rstrip("/").replace("'", "") + "'))").rlike(r"/\."))
    suffix = F.lower(F.regexp_extract("file", r"(\.[^.]+)$", 1))
    stem = F.regexp_replace("file", r"\.[^.]+$", "")
    df = df.select("path", "file", suffix.alias("suffix"), "size_bytes", governance.file_role(stem).alias("role"))
    return df.orderBy(F.col("role") != "train", F.col("role") != "test", F.desc("size_bytes"), "path")


def binary(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", F.col("length").alias("size_bytes"), "content")


def png_size(content: Column) -> Column:
    """(width, height) from a PNG header, else null."""
    part = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(part(17).alias("width"), part(21).alias("height")))


def wav_header(content: Column) -> Column:
    """(channels, rate, seconds) of WAV bytes; nulls for anything else."""

    def read(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in contents:
            try:
                with wave.open(io.BytesIO(raw)) as w:
                    rows.append((w.getnchannels(), w.getframerate(), round(w.getnframes() / max(w.getframerate(), 1), 4)))
            except (wave.Error, EOFError, TypeError):
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["channels", "rate", "seconds"])

    return F.pandas_udf(read, "struct<channels: int, rate: int, seconds: double>")(content)


def archive_suffixes(files: DataFrame, most: int = 12) -> DataFrame:
    """(path, suffix, n) of ZIP members, the most frequent suffixes of each archive."""

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"], strict=True):
                try:
                    members = [m for m in zipfile.ZipFile(io.BytesIO(raw)).namelist() if not m.endswith("/")]
                except zipfile.BadZipFile:
                    continue
                rows += [(path, PurePosixPath(m).suffix.lower(), k) for k, m in enumerate(members)]
            yield pd.DataFrame(rows, columns=["path", "suffix", "k"])

    from pyspark.sql import Window

    rows = files.select("path", "content").mapInPandas(names, "path string, suffix string, k int").groupBy("path", "suffix").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "k"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= most).select("path", "suffix", "n")


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 (without a byte-order mark) if valid, else GB18030."""
    plain = F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")
    other = F.pandas_udf(lambda s: s.map(lambda b: None if b is None else b.decode("gb18030", "replace")), "string")
    return F.coalesce(plain, other(F.when(plain.isNull(), content)))  # Python sees only what is not UTF-8


def text_stats(body: Column, most: int = 200_000) -> Column:
    """(chars, lines, mean_line) of the first characters."""
    t = F.substring(body, 1, most)
    # a line end ends a line and begins no further one
    lines = F.when(t == "", 0).otherwise(F.size(F.split(t, "\n")) - F.when(t.endswith("\n"), 1).otherwise(0))
    return F.struct(F.length(t).alias("chars"), lines.alias("lines"), F.coalesce(F.round(F.try_divide(F.length(F.replace(t, F.lit("\n"), F.lit(""))), lines), 3), F.lit(0.0)).alias("mean_line"))


def json_shape(body: Column) -> Column:
    """(keys, items): the first 40 sorted top-level keys of an object, or the length of a list."""
    return F.struct(F.slice(F.sort_array(F.json_object_keys(body)), 1, 40).alias("keys"), F.json_array_length(body).alias("items"))


def is_text(content: Column) -> Column:
    """No NUL in the first 8 KiB and less than 2 % of characters that do not decode; an empty file is text."""
    head = F.substring(content, 1, 8192)
    shown = F.make_valid_utf8(head.cast("string"))
    broken = F.length(shown) - F.length(F.replace(shown, F.lit("\ufffd"), F.lit("")))
    return ~F.coalesce(F.hex(head).rlike("^(?:..)*?00"), F.lit(False)) & (broken < 0.02 * F.greatest(F.length(shown), F.lit(1)))


def notebook_text(body: Column) -> Column:
    """Sources of a notebook's non-empty cells, joined by blank lines."""
    cells = F.from_json(body, "cells array<struct<source: array<string>>>").cells
    return F.array_join(F.filter(F.transform(cells, lambda c: F.array_join(c.source, "")), lambda s: F.trim(s) != ""), "\n\n")


def sniff_delimiter(sample: str, suffix: str = "") -> str:
    """Tab for .tsv; else of , tab ; | the one that cuts all lines of a sample alike, most often; else a comma."""
    if suffix.lower() == ".tsv":
        return "\t"
    lines = [x for x in sample[:8192].splitlines() if x][:50]
    counts = {d: [x.count(d) for x in lines] for d in ",\t;|"}
    even = {d: c[0] for d, c in counts.items() if c and c[0] and len(set(c)) == 1}
    return max(even, key=even.get) if even else ","


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or TSV (all columns as strings), Parquet, ORC, JSON or Feather file by its suffix."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in (".csv", ".tsv"):
        head = "\n".join(r["value"] for r in spark.read.text(path).limit(50).collect())
        return spark.read.option("header", "true").option("sep", sniff_delimiter(head, suffix)).option("encoding", "UTF-8").csv(path)
    if suffix == ".feather":
        import pyarrow.feather

        return spark.createDataFrame(pyarrow.feather.read_table(path))
    kind = {".parquet": "parquet", ".orc": "orc", ".json": "json", ".jsonl": "json"}.get(suffix)
    if kind is None:
        raise ValueError(f"no reader for {suffix}")
    return spark.read.format(kind).load(path)


def read_catalogs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Entries of catalog JSON files with their order and tier (learned, full or curated, by file name)."""
    out = None
    for k, path in enumerate(paths):
        name = PurePosixPath(path).name
        tier = "learned" if "learned" in name else "full" if "full" in name else "curated"
        df = spark.read.option("multiLine", "true").json(path).select(F.posexplode("entries").alias("_k", "e")).select(F.lit(k).alias("_file"), "_k", "e.*").withColumn("catalog_tier", F.lit(tier))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def query_inputs(values: list[str], files: list[tuple[str, str]]) -> list[str]:
    """Queries from arguments and (name, content) files: JSON list or {"queries": []}, else lines without marks and comments."""
    import re

    out = [*values]
    for name, body in files:
        if name.lower().endswith(".json"):
            data = json.loads(body)
            out += data["queries"] if isinstance(data, dict) else data
        else:
            out += [re.sub(r"^\s*(?:[-*+]|\d+[.)])\s+", "", x) for x in body.splitlines() if not x.lstrip().startswith("#")]
    return list(dict.fromkeys(str(q).strip() for q in out if str(q).strip()))
