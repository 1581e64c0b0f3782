"""Static audit of training scripts: syntax-tree rules in Python, the rest as expressions."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values ---
SEVERITIES = ["blocker", "high", "medium", "low", "info"]
FITTING = {"fit", "fit_transform", "fit_resample", "partial_fit"}
RANDOM_SPLITTERS = {"KFold", "StratifiedKFold", "train_test_split", "ShuffleSplit", "StratifiedShuffleSplit"}
SEEDS = ["random_state", "manual_seed", "seed_everything", "np.random.seed", "random.seed"]
DISCOVERY = ["glob(", "rglob(", "os.walk", "listdir(", "iterdir("]
# --- end of fixed values ---


def _words(node: ast.AST) -> set[str]:
    out = set()
    for n in ast.walk(node):
        value = n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else n.value if isinstance(n, ast.Constant) else None
        if isinstance(value, str):
            out.add(value.lower())
    return out


def _names(node: ast.AST, word: str) -> bool:
    return any(re.search(rf"(?:^|[^a-z0-9]){word}(?:[^a-z0-9]|$)", v) for v in _words(node))


def tree_findings(source: str, targets: set[str], group_risk: bool, time_risk: bool) -> list[tuple[str, str, int]]:
    """(severity, rule, line) of one script's syntax tree."""
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return [("blocker", "syntax-error", e.lineno or 0)]
    out, splits, early = [], [], []
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            name = getattr(n.func, "id", getattr(n.func, "attr", ""))
            if name in FITTING and any(_names(a, "test") for a in n.args):
                out.append(("blocker", "fit-on-test", n.lineno))
            if name == "fit_transform":
                early.append(n.lineno)
            if name in RANDOM_SPLITTERS:
                splits.append(n.lineno)
            if name == "concat" and _names(n, "test") and _names(n, "train"):
                out.append(("high", "train-test-concat", n.lineno))
        elif isinstance(n, ast.Subscript) and _names(n.value, "test") and ast.unparse(n.slice).strip("'\"").lower() in targets:
            out.append(("blocker", "test-target-access", n.lineno))
    out += [("high", "group-risk-random-split", k) for k in splits if group_risk]
    out += [("high", "time-risk-random-split", k) for k in splits if time_risk]
    out += [("high", "preprocess-before-split", k) for k in early if splits and k < min(splits)]
    return out


def audit(scripts: DataFrame) -> DataFrame:
    """(script, severity, rule, line), each once, from rows (script, source, targets, group_risk, time_risk, metric, required_files)."""

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.script, *f) for r in b.itertuples() for f in tree_findings(r.source or "", {str(t).lower() for t in (r.targets if r.targets is not None else [])}, bool(r.group_risk), bool(r.time_risk))]
            yield pd.DataFrame(rows, columns=["script", "severity", "rule", "line"])

    found = scripts.select("script", "source", "targets", "group_risk", "time_risk").mapInPandas(trees, "script string, severity string, rule string, line int")
    low = F.lower(F.coalesce("source", F.lit("")))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    metric = F.filter(F.regexp_extract_all(F.lower(F.coalesce("metric", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 1)
    files = F.coalesce("required_files", F.array().cast("array<string>"))
    base = lambda p: F.element_at(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"), -1)
    unread = F.size(F.filter(files, lambda p: ~F.contains(low, F.lower(base(p))) & ~F.contains(low, F.lower(F.replace(p, F.lit("\\"), F.lit("/")))))) > 0
    tests = [
        ("medium", "unused-data-sources", unread & ~any_of(DISCOVERY)), ("info", "dynamic-data-usage", unread & any_of(DISCOVERY)), ("low", "seed-not-observed", ~any_of(SEEDS)),
        ("medium", "metric-not-observed", (F.size(metric) > 0) & ~F.exists(metric, lambda w: F.contains(low, w))),
        ("medium", "submission-template-not-observed", F.contains(low, F.lit("to_csv")) & ~any_of(["sample_submission", "sample submission"])),
    ]
    rows = F.filter(F.array(*[F.when(t, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"), F.lit(0).alias("line"))) for s, r, t in tests]), lambda x: x.isNotNull())
    return found.unionByName(scripts.select("script", F.inline(rows))).distinct()


def report(findings: DataFrame) -> DataFrame:
    """(script, one count for each severity, status): fail on a blocker, review on a high, else pass."""
    g = findings.groupBy("script").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return g.withColumn("status", F.when(F.col("blocker") > 0, "fail").when(F.col("high") > 0, "review").otherwise("pass"))


def ordered(findings: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return findings.orderBy("script", rank, "line", "rule")
