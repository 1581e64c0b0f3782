"""Experience cards: lessons, digests, integrity rules, quality gates, catalog roll-up, manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import governance, text

HEX64 = "^[0-9a-f]{64}$"


def digest(card: Column) -> Column:
    """sha256 of a card's canonical JSON (sorted keys, no spaces, non-ASCII kept) without its own hash."""

    def one(raw: str | None) -> str | None:
        if raw is None:
            return None
        card = {k: v for k, v in json.loads(raw).items() if k != "card_hash"}
        return hashlib.sha256(json.dumps(card, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    return F.pandas_udf(lambda s: s.map(one), "string")(card)


def lessons(experiments: DataFrame, analyses: DataFrame, ablations: DataFrame) -> DataFrame:
    """Experiments with their latest analysis and ablation as lessons; verdicts decide validated or negative."""
    last = analyses.groupBy("experiment_id").agg(F.max_by(F.struct("verdict", "mechanism", "fold_count", "fold_wins"), "version").alias("a"))
    rows = experiments.join(last, "experiment_id").join(ablations.select("ablation_id", "factor"), "ablation_id", "left")
    kind = F.when(F.col("a.verdict").isin("supported", "partially_supported"), "validated").otherwise("negative")
    strong = (F.col("a.verdict") == "supported") & (F.col("a.fold_count") >= 3) & (F.col("a.fold_wins") / F.col("a.fold_count") >= 2 / 3)
    sure = F.when(strong, "high").when(F.col("a.verdict").isin("supported", "partially_supported"), "medium").otherwise("low")
    return rows.select("experiment_id", "a.verdict", "a.mechanism", "factor", kind.alias("kind"), sure.alias("confidence"))


def evidence_errors(items: Column) -> Column:
    """Problems of code-evidence items: path, lines, excerpt, hashes."""

    def rules(x: Column) -> Column:
        tests = [
            (x.path.startswith("/") | x.path.rlike(r"^[A-Za-z]:") | x.path.rlike(r"(^|[\\/])\.\.([\\/]|$)"), "path is not relative"),
            (~((x.start_line >= 1) & (x.end_line >= x.start_line) & (x.end_line - x.start_line < 120)), "bad line range"),
            (F.trim(x.excerpt) == "", "empty excerpt"), (F.sha2(x.excerpt, 256) != x.content_sha256, "stale content hash"), (~x.source_sha256.rlike(HEX64), "bad source hash"),
        ]
        return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(m)) for t, m in tests]), lambda m: m.isNotNull())

    return F.flatten(F.transform(items, rules))


def provenance_errors(url: Column, commit: Column, licence: Column) -> Column:
    tests = [(~governance.public_url(url), "no repository URL"), (~F.coalesce(commit, F.lit("")).rlike("^[0-9a-f]{7,64}$"), "no commit"), (F.trim(F.coalesce(licence, F.lit(""))) == "", "no license")]
    return F.filter(F.array(*[F.when(t, F.lit(m)) for t, m in tests]), lambda m: m.isNotNull())


def gate(blockers: Column, warnings: Column) -> Column:
    """(status, score): any blocker fails; 25 off for a blocker, 4 for a warning."""
    score = F.greatest(F.lit(0), 100 - 25 * F.size(blockers) - 4 * F.size(warnings))
    return F.struct(F.when(F.size(blockers) == 0, "pass").otherwise("fail").alias("status"), score.alias("score"))


def catalog_quality(base: Column, validated: Column, negative: Column) -> Column:
    return F.least(F.lit(300), base + 12 * validated + 5 * negative)


def file_score(path: Column, kind: Column, chars: Column, hints: list[str], role_hints: list[str] | None = None) -> Column:
    """Additive score of a collected file: 12 a write-up hint and 6 a code role in its name; tests lose 18."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    out = F.when(kind == "writeup", 70).when(kind == "code", 45).when(kind == "config", 28).otherwise(0)
    out = out + F.when(name.isin("readme.md", "write-up.md", "writeup.md", "solution.md"), 45).otherwise(0)
    for h in hints:
        out = out + F.when(name.contains(h), 12).otherwise(0)
    for h in role_hints or []:
        out = out + F.when(name.contains(h), 6).otherwise(0)
    out = out + F.when(low.rlike("1st|first|winner|gold|第一|高分"), 18).otherwise(0)
    out = out - F.when(low.rlike("(^|/)tests/") | name.startswith("test_"), 18).otherwise(0)
    return out + F.least(F.lit(10), F.floor(F.floor(F.log2(F.greatest(chars, F.lit(1)))) / 2)).cast("int")


def fingerprint(content: Column) -> Column:
    """(size, sha256) of a text with its line ends made \\n."""
    plain = F.regexp_replace(content, "\r\n?", "\n")
    return F.struct(F.octet_length(plain).alias("size"), F.sha2(plain, 256).alias("sha256"))


def compare_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status) of every manifest row: ok, missing, optional_missing, size_mismatch, hash_mismatch."""
    rows = manifest.join(files.select("path", F.col("size").alias("_size"), F.col("sha256").alias("_hash")), "path", "left")
    status = (
        F.when(F.col("_hash").isNull() & F.col("required"), "missing").when(F.col("_hash").isNull(), "optional_missing")
        .when(F.col("_size") != F.col("size"), "size_mismatch").when(F.col("_hash") != F.col("sha256"), "hash_mismatch").otherwise("ok")
    )
    return rows.select("path", status.alias("status"))


def quotas(files: DataFrame, most: int) -> DataFrame:
    """Stratified choice: write-ups and configs have quotas, the best of the rest fill up."""
    from pyspark.sql import Window

    limits = {"writeup": max(1, min(6, most // 4)), "config": min(4, most // 8)}
    w = Window.partitionBy("kind").orderBy(F.desc("score"), "path")
    limit = F.when(F.col("kind") == "writeup", limits["writeup"]).when(F.col("kind") == "config", limits["config"]).otherwise(0)
    rows = files.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).withColumn("_first", F.when(F.col("_n") <= limit, 0).otherwise(1))
    return rows.orderBy("_first", F.desc("score"), "path").limit(most).select(*files.columns).orderBy(F.desc("score"), "path")


def keywords(domains: Column, mechanisms: Column, risks: Column, custom: Column, words: Column) -> Column:
    return text.ordered_distinct(F.concat(domains, mechanisms, risks, custom, words), 48)
