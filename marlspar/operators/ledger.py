"""Experiment-ledger analytics: running best, plateaus, budgets, stability, versions, lineage, next action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store


def improves(candidate: Column, best: Column, direction: str = "higher", min_delta: float = 0.0) -> Column:
    """A null best is always improved on."""
    ahead = candidate < best - min_delta if direction == "lower" else candidate > best + min_delta
    return F.coalesce(ahead, best.isNull() & candidate.isNotNull())


def running_best(runs: DataFrame, key: str, order: list[str], value: str, ok: Column, direction: str = "higher", min_delta: float = 0.0) -> DataFrame:
    """Adds previous_best, delta and improved of each run, in order within its key.

    The best moves only when a run improves by more than min_delta, so for min_delta > 0 it is a fold over the
    ordered runs; for 0 it equals a running extreme, which a window gives without collecting a key's runs.
    """
    if min_delta == 0:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        best = (F.min if direction == "lower" else F.max)(F.when(ok, F.col(value))).over(w)
        out = runs.withColumn("previous_best", best)
    else:
        rows = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v"), ok.alias("_ok"), F.struct("*").alias("_row"))))
        start = F.struct(F.lit(None).cast("double").alias("best"), F.array().cast("array<double>").alias("seen"))

        def step(acc: Column, r: Column) -> Column:
            better = r["_ok"] & improves(r["_v"], acc.best, direction, min_delta)
            return F.struct(F.when(better, r["_v"]).otherwise(acc.best).alias("best"), F.concat(acc.seen, F.array(acc.best)).alias("seen"))

        g = runs.groupBy(key).agg(rows.alias("_rows")).withColumn("_seen", F.aggregate("_rows", start, step, lambda acc: acc.seen))
        pairs = F.transform(F.arrays_zip("_rows", "_seen"), lambda z: F.struct(z["_rows"]["_row"].alias("_row"), z["_seen"].alias("previous_best")))
        out = g.select(F.inline(pairs)).select("_row.*", "previous_best")
    delta = F.when(ok, F.col(value) - F.col("previous_best"))
    return out.withColumn("delta", delta).withColumn("improved", ok & improves(F.col(value), F.col("previous_best"), direction, min_delta))


def plateau(runs: DataFrame, key: str, ok: Column, ordinal: Column) -> DataFrame:
    """Successes after the last improved one, by key; runs have improved."""
    last = Window.partitionBy(key)
    rows = runs.where(ok).withColumn("_o", ordinal).withColumn("_last", F.max(F.when(F.col("improved"), ordinal)).over(last))
    return rows.groupBy(key).agg(F.count_if(F.col("_last").isNull() | (F.col("_o") > F.col("_last"))).alias("plateau_count"))


def budget(runs: DataFrame, key: str, minutes: Column, terminal: Column, total: float) -> DataFrame:
    used = F.sum(F.when(terminal, F.greatest(F.lit(0.0), minutes)).otherwise(0.0))
    g = runs.groupBy(key).agg(used.alias("_used")).withColumn("_left", F.greatest(F.lit(0.0), total - F.col("_used")))
    exhausted = F.lit(total > 0) & (F.col("_left") <= 0)
    return g.select(
        key, F.round("_used", 3).alias("consumed_minutes"), F.round("_left", 3).alias("remaining_minutes"), F.round(F.col("_left") / total, 4).alias("remaining_fraction") if total else F.lit(None).cast("double").alias("remaining_fraction"),
        exhausted.alias("exhausted"), (F.lit(total > 0) & ~exhausted & (F.col("_left") / (total or 1) <= 0.1)).alias("low"),
    )


def stability(mean: Column, std: Column, observations: Column, relative: float = 0.025, minimum: int = 3, absolute: float | None = None) -> Column:
    """(unstable, reason, relative_std); an absolute threshold overrides the relative one."""
    rel = F.abs(std) / F.greatest(F.abs(mean), F.lit(1e-12))
    missing = mean.isNull() | std.isNull()
    judged = F.abs(std) > absolute if absolute is not None else rel > relative
    few = observations < minimum
    return F.struct(
        F.when(few | missing, False).otherwise(judged).alias("unstable"), F.when(few, "insufficient_observations").when(missing, "missing_mean_or_std").alias("reason"),
        F.when(~few & ~missing, F.round(rel, 6)).alias("relative_std"),
    )


def fold_deltas(left: Column, right: Column, direction: str = "higher") -> Column:
    """(deltas, count, wins, ties) of paired scores; empty unless both have the same size above zero."""
    paired = F.when((F.size(left) == F.size(right)) & (F.size(left) > 0), F.zip_with(left, right, lambda x, y: y - x)).otherwise(F.array().cast("array<double>"))
    ahead = (lambda x: x > 0) if direction == "higher" else (lambda x: x < 0)
    return F.struct(paired.alias("deltas"), F.size(paired).alias("count"), F.size(F.filter(paired, ahead)).alias("wins"), F.size(F.filter(paired, lambda x: x == 0)).alias("ties"))


def map_deltas(left: Column, right: Column) -> Column:
    """right - left for the keys of both maps."""
    return F.map_filter(F.map_zip_with(left, right, lambda _, x, y: y - x), lambda _, v: v.isNotNull())


def versions(logs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds version (1, 2, ...) and is_latest within each key."""
    w = Window.partitionBy(key)
    out = logs.withColumn("version", F.row_number().over(w.orderBy(*order)))
    return out.withColumn("is_latest", F.col("version") == F.max("version").over(w))


def with_latest(experiments: DataFrame, logs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Experiments with the verdict of their last analysis, or `pending`."""
    last = logs.groupBy(key).agg(F.max_by("verdict", F.struct(*order)).alias("verdict"))
    return experiments.join(last, key, "left").withColumn("verdict", F.coalesce("verdict", F.lit("pending")))


def parent_deltas(runs: DataFrame, key: str, parent: str, values: list[str]) -> DataFrame:
    """Null-safe child - parent of each value."""
    up = runs.select(F.col(key).alias(parent), *[F.col(v).alias(f"_{v}") for v in values])
    return runs.join(up, parent, "left").select(key, parent, *[(F.col(v) - F.col(f"_{v}")).alias(f"{v}_delta") for v in values])


def lineage(runs: DataFrame, starts: DataFrame, key: str, parent: str) -> DataFrame:
    """(start, depth, key) from each start up to its root; a cycle ends at its first repeated run. A run has one parent.

    Jumps of 1, 2, 4, ... generations are tables of their own; taken from the longest to the shortest, each doubles the
    depths reached, so that neither the depth nor the number of rows is bounded. Runs on a cycle, which long jumps end at,
    are roots of the jumps; what follows on their cycle is joined to the starts that end there.
    """
    up = store.kept(runs.select(F.col(key).alias("k"), F.col(parent).alias("p")).where("k is not null and p is not null"), "lineage-parents")
    first = starts.select(F.col(key).alias("start"), F.lit(0).alias("depth"), F.col(key).alias("k"))
    jumps, left = _jumps(up)
    if left is None:
        return _climbed(first, jumps).select("start", "depth", F.col("k").alias(key))
    # after as many generations as there are runs every jump ends on a cycle, and each of its runs is an end
    ring = store.kept(up.join(left.select(F.col("p").alias("k")).distinct(), "k", "left_semi"), "lineage-cycles")
    tails, _ = _jumps(store.kept(up.join(ring, "k", "left_anti"), "lineage-tails"))
    spots = _cycle_places(ring)
    climbed = store.kept(_climbed(first, tails), "lineage-climbed")
    on = climbed.join(spots.withColumnRenamed("place", "_from"), "k").select("start", "depth", "cycle", "size", "_from")
    turn = F.pmod(F.col("_from") - F.col("place"), F.col("size")).cast("int")
    rest = on.join(spots.select("cycle", "place", "k"), "cycle").select("start", (F.col("depth") + turn).alias("depth"), "k", turn.alias("_turn")).where("_turn > 0")
    return climbed.unionByName(rest.drop("_turn")).select("start", "depth", F.col("k").alias(key))


def _jumps(up: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (k, p) of 1, 2, 4, ... generations, and the jumps still left after more generations than runs, if any."""
    out, reached, count = [], 1, None
    jump = up
    while not jump.isEmpty():
        count = up.count() if count is None else count
        if reached > count:
            return out, jump
        out.append(jump)
        jump = store.kept(jump.join(jump.select(F.col("k").alias("p"), F.col("p").alias("_p")), "p").select("k", F.col("_p").alias("p")), "lineage-jumps")
        reached *= 2
    return out, None


def _climbed(first: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(start, depth, k) of all runs above the starts."""
    out = first
    for n in range(len(jumps) - 1, -1, -1):
        out = store.kept(out, "lineage-steps")
        out = out.unionByName(out.join(jumps[n], "k").select("start", (F.col("depth") + (1 << n)).alias("depth"), F.col("p").alias("k")))
    return out


def _cycle_places(ring: DataFrame) -> DataFrame:
    """(cycle, size, place, k): of a run on a cycle the cycle's smallest run and the generations up to that."""
    near, reached, count = ring.select("k", "p", F.least("k", "p").alias("low")), 1, ring.count()
    while reached < count:
        far = near.select(F.col("k").alias("p"), F.col("p").alias("_p"), F.col("low").alias("_low"))
        near = store.kept(near.join(far, "p").select("k", F.col("_p").alias("p"), F.least("low", "_low").alias("low")), "lineage-lows")
        reached *= 2
    own = near.select("k", F.col("low").alias("cycle"))
    opened = store.kept(ring.join(own, "k").where("k <> cycle").select("k", "p"), "lineage-opened")
    steps = store.kept(_climbed(ring.select(F.col("k").alias("start"), F.lit(0).alias("depth"), "k"), _jumps(opened)[0]).groupBy("start").agg(F.max("depth").alias("place")), "lineage-places")
    sizes = own.groupBy("cycle").agg(F.count(F.lit(1)).alias("size"))
    return own.join(sizes, "cycle").join(steps.withColumnRenamed("start", "k"), "k").select("cycle", "size", "place", "k")


def next_action(state: DataFrame) -> Column:
    """Mode by the ordered decision list over one row of ledger sums."""
    c = F.col
    steps = [
        ((c("status") == "postmortem") & (c("experience_status") == "draft"), "review_experience"), (c("status") == "postmortem", "promote_experience"), (c("status") == "complete", "complete"),
        (c("deadline_expired") | c("exhausted"), "finalize_with_current_best"), (~c("validation_verified"), "validation"), (~c("baseline_established"), "baseline"),
        (c("last_status") == "failed", "debug"), (c("pending_research") > 0, "source_competition_deep_dive"), (c("needs_analysis"), "analyze_experiment"), (c("unstable"), "stabilize_validation"),
        (c("planned_ablations") > 0, "run_planned_ablation"), (c("low"), "budget_constrained_refinement"), (c("plateau_count") >= 3, "cross_branch_exploration"), (c("last_improved"), "targeted_refinement"),
    ]
    out = None
    for test, mode in steps:
        out = (F if out is None else out).when(F.coalesce(test, F.lit(False)), mode)
    return out.otherwise("next_high_information_experiment")


def stage(validated: Column, baseline: Column, successes: Column, plateau_count: Column) -> Column:
    return F.when(~validated, "validation").when(~baseline, "baseline").when((successes >= 4) & (plateau_count >= 3), "explore").otherwise("improve")


def new_research(claims: DataFrame, known: DataFrame, ids: list[str], offset: int = 0) -> DataFrame:
    """Claims whose identity is not known yet, each once, numbered R001, R002, ... in order; identity and `ord` are columns."""
    w = Window.partitionBy("identity").orderBy("ord")
    fresh = claims.join(known.select("identity"), "identity", "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    number = F.row_number().over(Window.orderBy("ord")) + offset  # an import batch, some hundreds of rows
    return fresh.withColumn("research_id", F.format_string("R%03d", number)).select("research_id", "identity", *ids)


def resolved(sources: Column, official: Column, several: Column, allow_single: Column, texts: list[Column], has_hash: Column) -> Column:
    """Problems that keep a research task from being verified."""
    tests = [
        (F.size(sources) < 1, "no source"), (several & ~allow_single & (F.size(sources) < 2), "needs two sources"), (~official, "official page not checked"),
        *[(F.trim(F.coalesce(t, F.lit(""))) == "", f"text {k} missing") for k, t in enumerate(texts)], (~has_hash, "no content hash or commit"),
    ]
    return F.filter(F.array(*[F.when(t, F.lit(x)) for t, x in tests]), lambda x: x.isNotNull())


def confidence(verdict: Column, folds: Column, wins: Column) -> Column:
    strong = (verdict == "supported") & (folds >= 3) & (wins / folds >= 2 / 3)
    return F.when(strong, "high").when(verdict.isin("supported", "partially_supported"), "medium").otherwise("low")
