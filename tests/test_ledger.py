"""The ledger: what actions lead to, what is refused, commits of concurrent writers, snapshots."""

import random
import threading

import pytest

from marlspar.operators import replay
from marlspar.sources import commits, store


def act(kind, id=None, workspace="w", run_id="r", **more):
    return {"workspace": workspace, "run_id": run_id, "kind": kind, "id": id} | more


def fold(spark, actions):
    kinds = replay.ACTION + ", commit long, seq int"
    names = [c.strip().split(" ")[0] for c in kinds.split(", ")]
    rows = [tuple((a | {"commit": k, "seq": 0}).get(n) for n in names) for k, a in enumerate(actions)]
    return replay.replay(spark.createDataFrame(rows, kinds).repartition(3))


def table(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("place").collect()]


def test_best_moves_by_more_than_min_delta(spark):
    r = random.Random(3)
    for direction, sign in (("higher", 1), ("lower", -1)):
        scores = [round(r.random(), 3) for _ in range(40)]
        got = fold(spark, [act("begin", direction=direction), *[act("record", f"E{k}", status="success", cv=v, min_delta=0.1, component="model") for k, v in enumerate(scores)]])
        best, name, want = None, None, []
        for k, v in enumerate(scores):
            improved = best is None or sign * v > sign * best + 0.1 if direction == "higher" else best is None or v < best - 0.1
            want.append((f"E{k}", name, improved, None if best is None else v - best))
            if improved:
                best, name = v, f"E{k}"
        assert table(got.experiments, "id", "parent", "improved", "delta") == want
        state = got.workspaces.collect()[0]
        assert (state.best, state.best_cv, state.experiments) == (name, best, 40)


def test_stages_ablations_and_analysis(spark):
    got = fold(spark, [
        act("begin"), act("record", "V", component="validation", status="success", cv=0.5, lb=0.4, runtime_minutes=10.0), act("record", "B", component="baseline", status="running"),
        act("finalize", "B", status="success", cv=0.6), act("plan", "A1", component="model"), act("plan", "A2", parent="V"), act("record", "E1", ablation="A1", status="running"),
        act("record", "E1b", ablation="A1", status="failed"), act("finalize", "E1", status="success", cv=0.55, runtime_minutes=5.0), act("record", "E2", ablation="A2", parent="V", status="discarded"),
        act("record", "E3", status="success", cv=0.1), act("record", "E4", status="success"), act("record", "E5", status="success", cv=0.2), act("analyze", "E1", verdict="supported"), act("analyze", "E1", verdict="refuted"),
    ])
    assert got.refused.count() == 0
    state = got.workspaces.collect()[0]
    assert (state.stage, state.validated, state.baseline, state.best, state.best_cv, state.best_lb, state.plateau, state.used_minutes) == ("explore", True, True, "B", 0.6, 0.4, 4, 15.0)
    assert table(got.ablations, "id", "parent", "status", "experiment", "decision") == [("A1", "B", "completed", "E1b", "refuted"), ("A2", "V", "discarded", "E2", "pending")]
    assert [x for x in table(got.experiments, "id", "parent", "analysis_status", "analysis_version") if x[0] in ("E1", "E3")] == [("E1", "B", "complete", 2), ("E3", "B", "pending", None)]


def test_what_breaks_a_rule_changes_nothing(spark):
    good = [act("begin"), act("record", "E1", status="success", cv=0.5), act("plan", "A1"), act("research", "R1"), act("research", "R2"), act("record", "E2", ablation="A1", status="failed")]
    full = {"urls": ["https://a.org/x"], "flags": ["immutable"], "texts": ["a", "b", "c"], "status": "verified"}
    bad = [
        (act("record", "E9", run_id="other", status="success"), "not the owner"), (act("record", "E9", workspace="x", status="success"), "no run"), (act("record", "E9", workspace=None, status="success"), "no workspace"),
        (act("begin"), "a run exists"), (act("begin", workspace="y", budget_hours=0.0), "the budget must be positive"), (act("record", "E1", status="success"), "the experiment exists"),
        (act("record", "E9", status="odd"), "unknown status"), (act("record", "E9", status="success", runtime_minutes=-1.0), "negative runtime"), (act("record", "E9", ablation="A7", status="success"), "unknown ablation"),
        (act("record", "E9", ablation="A1", status="success"), "the ablation is already failed"), (act("finalize", "E1", status="success"), "the experiment is not running"), (act("finalize", "E7", status="failed"), "unknown experiment"),
        (act("plan", "A1"), "the ablation exists"), (act("plan", "A3", parent="E7"), "unknown parent"), (act("plan", "A3", research_ids=["R1"]), "research R1 is not verified"), (act("plan", "A3", research_ids=["R7"]), "unknown research R7"),
        (act("analyze", "E7"), "unknown experiment"), (act("resolve", "R7", status="verified"), "unknown research task"), (act("resolve", "R1", **full | {"urls": []}), "no public source"),
        (act("resolve", "R1", **full | {"flags": ["immutable", "multiple_sources"]}), "needs two sources"), (act("resolve", "R1", **full | {"flags": ["immutable", "official_page"]}), "official page not checked"),
        (act("resolve", "R1", **full | {"texts": ["a", " ", "c"]}), "conditions or evidence missing"), (act("resolve", "R1", **full | {"flags": []}), "no content hash or commit"), (act("dance", "E1"), "unknown kind of action"),
    ]
    got = fold(spark, good + [a for a, _ in bad])
    assert [(r.commit, r.problem) for r in got.refused.orderBy("commit").collect()] == [(len(good) + k, p) for k, (_, p) in enumerate(bad)]
    clean = fold(spark, good)
    for name in ("workspaces", "experiments", "ablations", "research"):
        assert sorted(map(str, getattr(got, name).collect())) == sorted(map(str, getattr(clean, name).collect()))
    more = fold(spark, [*good, act("resolve", "R1", **full), act("plan", "A3", parent="E1", research_ids=["R1"]), act("record", "E3", ablation="A3", parent="E1", status="running"), act("begin", run_id="r2", force=True)])
    assert more.refused.count() == 0 and [(r.run_id, r.experiments) for r in more.workspaces.collect()] == [("r2", 0)]
    assert fold(spark, []).workspaces.count() == 0


def test_many_workspaces_and_extra_columns(spark):
    actions = [a for k in range(60) for a in (act("begin", workspace=f"w{k}"), act("record", "E", workspace=f"w{k}", status="success", cv=float(k)))]
    got = fold(spark, actions)
    assert sorted((r.workspace, r.best_cv) for r in got.workspaces.collect()) == sorted((f"w{k}", float(k)) for k in range(60))
    rows = spark.createDataFrame([("w", "r", "begin", 1, 1)], "workspace string, run_id string, kind string, place int, what int")
    assert replay.replay(rows).workspaces.count() == 1


def test_concurrent_writers_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "SNAPSHOT", 4)
    ledger = commits.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.last() == 0 and ledger.state().workspaces.count() == 0
    ledger.commit(act("begin"))
    lost = []

    def write(k):
        for j in range(3):
            try:
                ledger.commit(act("record", f"E{k}-{j}", status="success", cv=k + j / 10))
            except Exception as e:  # noqa: BLE001
                lost.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not lost and ledger.last() == 10
    state = ledger.state()
    assert {r.id for r in state.experiments.collect()} == {f"E{k}-{j}" for k in range(3) for j in range(3)}
    assert state.workspaces.collect()[0].best == "E2-2" and state.refused.count() == 0
    assert len(store.names(spark, f"{ledger.root}/snapshots")) == 4  # two tables, two that publish them
    with pytest.raises(commits.RefusedActions, match="the experiment exists"):
        ledger.commit(act("record", "E9", status="success", cv=9.0), act("record", "E0-0", status="success", cv=9.0))
    with pytest.raises(commits.RefusedActions, match="not the owner"):
        ledger.commit(act("record", "E9", run_id="x", status="success"))
    with pytest.raises(ValueError, match="unknown fields"):
        ledger.commit(act("record", "E9", colour="red"))
    assert ledger.last() == 10 and ledger.actions(4).count() == 4
