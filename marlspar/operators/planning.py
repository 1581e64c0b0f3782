"""What to try and to check next: families, decisions, gates, kinds of files, and the ledger's appended and finished runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from . import ledger
from .briefing import suffix


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def family_hypotheses(rows: DataFrame, key: str) -> DataFrame:
    """(key, place, domain, families, signals) for each known domain of rows (key, domains, data, risks), in the order of `domains`.

    Rows without a known domain give one for `unclassified`. Signals are the first six distinct ones, data before risks; null lists are empty.
    """
    known = F.create_map(*[x for d, f in vocab.FAMILIES.items() for x in (F.lit(d), _strings(f))])
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    own = F.filter(listed("domains"), lambda d: F.coalesce(F.map_contains_key(known, d), F.lit(False)))
    signals = F.slice(F.array_distinct(F.concat(listed("data"), listed("risks"))), 1, 6)
    none = F.array(F.struct(F.lit(vocab.NO_DOMAIN).alias("domain"), _strings(vocab.NO_FAMILIES).alias("families"), _strings(vocab.NO_SIGNALS).alias("signals")))
    some = F.transform("_own", lambda d: F.struct(d.alias("domain"), F.try_element_at(known, d).alias("families"), F.col("_signals").alias("signals")))
    wide = rows.select(key, own.alias("_own"), signals.alias("_signals"))
    return wide.select(key, F.posexplode(F.when(F.size("_own") == 0, none).otherwise(some)).alias("place", "_h")).select(key, "place", "_h.*")


def decision(unknowns: Column, confidence: Column, stage: Column) -> Column:
    """(next_mode, reason, hard_rule): facts first, then evidence, then a baseline."""
    mode = F.when(F.size(F.coalesce(unknowns, F.array().cast("array<string>"))) > 0, "inspect").when(confidence == "low", "research").when(stage.isin("intake", "eda"), "baseline").otherwise("experiment")
    why = F.create_map(*[F.lit(x) for pair in vocab.DECISIONS.items() for x in pair])
    return F.struct(mode.alias("next_mode"), F.element_at(why, mode).alias("reason"), F.lit(vocab.HARD_RULE).alias("hard_rule"))


def validation_contract(rows: DataFrame, key: str) -> DataFrame:
    """(key, place, gate, action, pass_condition) of the gates that rows (key, risks, metric_family) call for.

    A gate of metric families is not opened by a risk of that name, nor one of risks by a family.
    """
    families = _strings([*vocab.METRICS, "custom", "unknown"])
    calls = F.concat(F.array_except(F.coalesce("risks", F.array().cast("array<string>")), families), F.array_intersect(F.array("metric_family"), families))
    gates = F.array(*[F.struct(F.lit(g).alias("gate"), _strings(by).alias("by"), F.lit(do).alias("action"), F.lit(ok).alias("pass_condition")) for g, by, do, ok in vocab.GATES])
    due = F.filter(gates, lambda g: (F.size(g["by"]) == 0) | F.coalesce(F.arrays_overlap(g["by"], calls), F.lit(False)))
    return rows.select(key, F.posexplode(due).alias("place", "_g")).select(key, "place", "_g.gate", "_g.action", "_g.pass_condition")


def file_kind(name: Column, is_text: Column) -> Column:
    """code, config or writeup by the suffix; text whose name hints at a writeup is one too; else other."""
    own, out = suffix(name), None
    for kind, suffixes in vocab.KINDS.items():
        out = (F if out is None else out).when(own.isin(suffixes), kind)
    hinted = F.exists(_strings(vocab.WRITEUP_HINTS), lambda h: F.contains(F.lower(name), h))
    return out.when(hinted & is_text, "writeup").otherwise("other")


def linked(rows: DataFrame, tasks: DataFrame, key: str, ids: str, task: str, fields: list[str]) -> DataFrame:
    """(key, place, task, *fields) of the listed tasks that exist, places as in the list; tasks have one row an id."""
    listed = rows.select(key, F.posexplode(ids).alias("place", task))
    return listed.join(tasks.select(task, *fields), task).select(key, "place", task, *fields)


def finalize(runs: DataFrame, results: DataFrame, key: str, at: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(runs, refused): the first result by `at` ends a running run and sets its `fields`, status among them.

    Results of runs that are unknown, not running, or ended by an earlier result are refused with the problem; two results
    at one time are ordered by their fields. Runs have one row a key; results are reduced by key before they meet them.
    """
    when = F.struct(at, *fields)
    first = results.groupBy(key).agg(F.min(when).alias("_r"))
    ends = F.col("status") == "running"
    done = runs.join(first, key, "left")
    out = [F.when(ends & F.col("_r").isNotNull(), F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in runs.columns]
    place = F.row_number().over(Window.partitionBy(key).orderBy(when))
    status = runs.select(key, F.col("status").alias("_status"), F.lit(True).alias("_known"))
    late = results.withColumn("_n", place).join(status, key, "left")
    problem = F.when(F.col("_known").isNull(), "unknown").when(~F.col("_status").eqNullSafe("running"), "not running").when(F.col("_n") > 1, "ended before")
    return done.select(*out), late.withColumn("problem", problem).where("problem is not null").select(*results.columns, "problem")


def with_parents(runs: DataFrame, group: str, order: str, key: str, parent: str, value: str, direction: str = "higher", min_delta: float = 0.0) -> DataFrame:
    """Runs whose empty parent is filled with the best success before them in their group; of equal values the earlier one is best.

    The best moves only by more than min_delta, so it is the last run before that improved (`ledger.running_best`).
    """
    ok = (F.col("status") == "success") & F.col(value).isNotNull()
    moved = ledger.running_best(runs, group, [order], value, ok, direction, min_delta)
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.last(F.when(F.col("improved"), F.col(key)), ignorenulls=True).over(before)
    return moved.withColumn(parent, F.coalesce(F.col(parent), best)).select(*runs.columns)


def ablation_status(ablations: DataFrame, runs: DataFrame, key: str, order: str) -> DataFrame:
    """Ablations with the status that their last run by `order` gives; those without a run keep theirs."""
    last = runs.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("status", order).alias("_s"))
    moved = F.when(F.col("_s") == "success", "completed").when(F.col("_s").isin("failed", "discarded", "running"), F.col("_s"))
    return ablations.join(last, key, "left").withColumn("status", F.coalesce(moved, "status")).drop("_s")
