"""The state of experiment ledgers as a fold of their actions.

An action is one row: begin a run, plan an ablation, record or finalize an experiment, analyse one, add or resolve a research
task, draft, review or promote the run's card. Actions are dealt by workspace and sorted by commit and place in it; a task folds them one after another, so that what
it holds is one workspace's open state and never its actions. What breaks a rule changes nothing and comes back as refused,
with the problem.

Cases: an action of a workspace without a run, of another run's id, with an id that exists or one that is unknown is refused;
a success without a score improves nothing; of equal scores the earlier stays best; with min_delta the best moves only by
more than it; rows without a workspace are refused; no actions give no states.
A card goes from draft over reviewed to promoted; a promotion with another hash than the reviewed one is refused, and a draft
or an experiment after it opens the run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store

ACTION = (
    "workspace string, run_id string, kind string, id string, parent string, ablation string, component string, status string, cv double, lb double, min_delta double, "
    "runtime_minutes double, budget_hours double, direction string, verdict string, research_ids array<string>, urls array<string>, flags array<string>, texts array<string>, force boolean, payload string"
)
OUT = (
    "what string, workspace string, run_id string, place int, commit long, seq int, kind string, id string, parent string, ablation string, component string, status string, cv double, lb double, "
    "improved boolean, delta double, analysis string, version int, stage string, validated boolean, baseline boolean, plateau int, used_minutes double, problem string, hash string"
)
ENDED = {"success": "completed", "failed": "failed", "discarded": "discarded"}


class Refused(Exception):
    """An action that breaks a rule."""


def better(value: float, best: float | None, direction: str, least: float) -> bool:
    if best is None:
        return True
    return value < best - least if direction == "lower" else value > best + least


@dataclass
class Workspace:
    """Open state of one workspace."""

    run_id: str | None = None
    direction: str = "higher"
    best: str | None = None
    best_cv: float | None = None
    best_lb: float | None = None
    validated: bool = False
    baseline: bool = False
    stage: str = "intake"
    runs: dict[str, dict] = field(default_factory=dict)
    ablations: dict[str, dict] = field(default_factory=dict)
    research: dict[str, str] = field(default_factory=dict)
    card: dict | None = None

    def apply(self, a: dict) -> None:
        """One action; raises Refused and changes nothing if it breaks a rule."""
        if a["kind"] == "begin":
            self._begin(a)
            return
        if self.run_id is None:
            raise Refused("no run")
        if a["run_id"] != self.run_id:
            raise Refused("not the owner")
        step = {"plan": self._plan, "record": self._record, "finalize": self._finalize, "analyze": self._analyze, "research": self._add, "resolve": self._resolve, "draft": self._draft, "review": self._review, "promote": self._promote}.get(a["kind"])
        if step is None:
            raise Refused("unknown kind of action")
        step(a)

    def _begin(self, a: dict) -> None:
        if self.run_id is not None and not a["force"]:
            raise Refused("a run exists")
        if not a["run_id"]:
            raise Refused("no run id")
        if a["budget_hours"] is not None and a["budget_hours"] <= 0:
            raise Refused("the budget must be positive")
        self.__init__(a["run_id"], a["direction"] or "higher")

    def _verified(self, ids: list[str]) -> None:
        for i in ids:
            if i not in self.research:
                raise Refused(f"unknown research {i}")
            if self.research[i] != "verified":
                raise Refused(f"research {i} is not verified")

    def _plan(self, a: dict) -> None:
        if not a["id"] or a["id"] in self.ablations:
            raise Refused("the ablation exists")
        if a["parent"] and a["parent"] not in self.runs:
            raise Refused("unknown parent")
        self._verified(a["research_ids"])
        self.ablations[a["id"]] = {"id": a["id"], "status": "planned", "parent": a["parent"] or self.best, "component": a["component"], "run": None, "verdict": "pending", "research": a["research_ids"]}

    def _record(self, a: dict) -> None:
        if a["runtime_minutes"] is not None and a["runtime_minutes"] < 0:
            raise Refused("negative runtime")
        if not a["id"] or a["id"] in self.runs:
            raise Refused("the experiment exists")
        if a["status"] not in (*ENDED, "running"):
            raise Refused("unknown status")
        parent, planned, research = a["parent"] or self.best, None, a["research_ids"]
        if a["ablation"]:
            planned = self._known(self.ablations, a["ablation"], "ablation")
            if planned["status"] not in ("planned", "running"):
                raise Refused(f"the ablation is already {planned['status']}")
            if planned["parent"] and parent != planned["parent"]:
                raise Refused("the parent is not the ablation's control")
            research = [*research, *planned["research"]]
        self._verified(research)
        run = {"id": a["id"], "parent": parent, "ablation": a["ablation"], "component": a["component"], "analysis": "pending", "version": None}
        self.runs[a["id"]] = run
        if planned:
            planned["run"] = a["id"]
        self._ended(run, a)

    def _finalize(self, a: dict) -> None:
        run = self._known(self.runs, a["id"], "experiment")
        if a["runtime_minutes"] is not None and a["runtime_minutes"] < 0:
            raise Refused("negative runtime")
        if run["status"] != "running":
            raise Refused("the experiment is not running")
        if a["status"] not in ENDED:
            raise Refused("unknown status")
        self._ended(run, a)

    def _ended(self, run: dict, a: dict) -> None:
        """Result fields, the ablation's status, flags, best and stage."""
        ok = a["status"] == "success"
        scored = ok and a["cv"] is not None
        delta = a["cv"] - self.best_cv if scored and self.best_cv is not None else None
        improved = scored and better(a["cv"], self.best_cv, self.direction, a["min_delta"] or 0.0)
        run |= {"status": a["status"], "cv": a["cv"], "lb": a["lb"], "runtime": a["runtime_minutes"], "improved": improved, "delta": delta}
        if run["ablation"]:
            self.ablations[run["ablation"]]["status"] = ENDED.get(a["status"], "running")
        self.validated |= ok and run["component"] == "validation"
        self.baseline |= ok and run["component"] == "baseline"
        if improved:
            self.best, self.best_cv = run["id"], a["cv"]
            self.best_lb = self.best_lb if a["lb"] is None else a["lb"]
        won = sum(r["status"] == "success" for r in self.runs.values())
        self.stage = "validation" if not self.validated else "baseline" if not self.baseline else "explore" if won >= 4 and self.plateau() >= 3 else "improve"

    def _analyze(self, a: dict) -> None:
        run = self._known(self.runs, a["id"], "experiment")
        run["analysis"], run["version"] = "complete", (run["version"] or 0) + 1
        if run["ablation"]:
            self.ablations[run["ablation"]]["verdict"] = a["verdict"]

    def _add(self, a: dict) -> None:
        if not a["id"] or a["id"] in self.research:
            raise Refused("the research task exists")
        self.research[a["id"]] = "pending"

    def _resolve(self, a: dict) -> None:
        """texts: transfer and failure conditions, implementation evidence; flags: what is required, checked, hashed."""
        status = self._known(self.research, a["id"], "research task")
        if status != "pending":
            raise Refused(f"the research task is already {status}")
        if a["status"] == "verified":
            urls, flags = {*a["urls"]}, {*a["flags"]}
            tests = [
                (not urls, "no public source"), ("multiple_sources" in flags and len(urls) < 2 and "allow_single_source" not in flags, "needs two sources"),
                ("official_page" in flags and "official_checked" not in flags, "official page not checked"), (sum(bool((t or "").strip()) for t in a["texts"]) < 3, "conditions or evidence missing"),
                ("immutable" not in flags, "no content hash or commit"),
            ]
            for broken, problem in tests:
                if broken:
                    raise Refused(problem)
        self.research[a["id"]] = a["status"]

    def _draft(self, a: dict) -> None:
        """A new revision of the card; payload: its hash."""
        if not a["id"] or not a["payload"]:
            raise Refused("no card")
        if self.card and self.card["id"] != a["id"]:
            raise Refused("another card exists")
        self.card = {"id": a["id"], "status": "draft", "version": (self.card["version"] if self.card else 0) + 1, "hash": a["payload"]}
        self.stage = "postmortem"

    def _review(self, a: dict) -> None:
        """The gate's verdict (pass or fail) over the card of this hash."""
        card = self._own(a)
        card |= {"status": "reviewed" if a["status"] == "pass" else "draft", "hash": a["payload"]}
        self.stage = "postmortem"

    def _promote(self, a: dict) -> None:
        """Only what was reviewed goes up: status is the gate's verdict now, payload the card's hash now."""
        card = self._own(a)
        if card["status"] != "reviewed":
            raise Refused("the card has not passed review")
        if card["hash"] != a["payload"]:
            raise Refused("the card changed after review")
        if a["status"] != "pass":
            raise Refused("the card no longer passes the gate")
        card["status"], self.stage = "promoted", "complete"

    def _own(self, a: dict) -> dict:
        if not self.card or self.card["id"] != a["id"]:
            raise Refused("unknown card")
        return self.card

    @staticmethod
    def _known(table: dict, key: str | None, what: str):
        if key not in table:
            raise Refused(f"unknown {what}")
        return table[key]

    def plateau(self) -> int:
        n = 0
        for r in reversed(self.runs.values()):
            if r["status"] == "success":
                if r["improved"]:
                    break
                n += 1
        return n

    def rows(self, workspace: str) -> Iterator[dict]:
        """The state, then its experiments, ablations and research tasks in order."""
        base = {"workspace": workspace, "run_id": self.run_id}
        yield base | {"what": "state", "id": self.best, "cv": self.best_cv, "lb": self.best_lb, "stage": self.stage, "validated": self.validated, "baseline": self.baseline, "plateau": self.plateau(), "place": len(self.runs), "used_minutes": sum(r["runtime"] or 0.0 for r in self.runs.values())}
        for k, r in enumerate(self.runs.values(), 1):
            yield base | {"what": "experiment", "place": k, **{c: r[c] for c in ("id", "parent", "ablation", "component", "status", "cv", "lb", "improved", "delta", "analysis", "version")}}
        for k, r in enumerate(self.ablations.values(), 1):
            yield base | {"what": "ablation", "place": k, "id": r["id"], "parent": r["parent"], "component": r["component"], "status": r["status"], "ablation": r["run"], "analysis": r["verdict"]}
        for k, (i, status) in enumerate(self.research.items(), 1):
            yield base | {"what": "research", "place": k, "id": i, "status": status}
        if self.card:
            yield base | {"what": "card", "place": 1, **self.card}


_NAMES = [c.strip().split(" ")[0] for c in OUT.split(", ")]
_ROWS = 4096


def _plain(v):
    """A cell without pandas' missing values; lists as lists."""
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    return [*v] if hasattr(v, "__len__") and not isinstance(v, str) else v


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[dict] = []
    name, state, seen = None, Workspace(), False

    def full(limit: int) -> Iterator[pd.DataFrame]:
        if len(held) > limit:
            yield pd.DataFrame([[r.get(c) for c in _NAMES] for r in held], columns=_NAMES, dtype=object)
            held.clear()

    for batch in batches:
        for row in batch.to_dict("records"):
            a = {k: _plain(v) for k, v in row.items()}
            a |= {k: [] for k in ("research_ids", "urls", "flags", "texts") if a[k] is None}
            if seen and a["workspace"] != name:
                held.extend(state.rows(name) if state.run_id is not None else ())
                state = Workspace()
                yield from full(_ROWS)
            name, seen = a["workspace"], True
            try:
                if name is None:
                    raise Refused("no workspace")
                state.apply(a)
            except Refused as e:
                held.append({"what": "refused", "problem": str(e), **{c: a[c] for c in ("workspace", "run_id", "commit", "seq", "kind", "id")}})
                yield from full(_ROWS)
    if state.run_id is not None:
        held.extend(state.rows(name))
    yield from full(0)


@dataclass
class State:
    """Tables of what the actions led to."""

    all: DataFrame

    def _of(self, what: str, *columns) -> DataFrame:
        return self.all.where(F.col("what") == what).select("workspace", "run_id", *columns)

    @property
    def workspaces(self) -> DataFrame:
        c = F.col
        return self._of("state", "stage", "validated", "baseline", c("id").alias("best"), c("cv").alias("best_cv"), c("lb").alias("best_lb"), c("place").alias("experiments"), "plateau", "used_minutes")

    @property
    def experiments(self) -> DataFrame:
        return self._of("experiment", "place", "id", "parent", "ablation", "component", "status", "cv", "lb", "improved", "delta", F.col("analysis").alias("analysis_status"), F.col("version").alias("analysis_version"))

    @property
    def ablations(self) -> DataFrame:
        return self._of("ablation", "place", "id", "parent", "component", "status", F.col("ablation").alias("experiment"), F.col("analysis").alias("decision"))

    @property
    def research(self) -> DataFrame:
        return self._of("research", "place", "id", "status")

    @property
    def cards(self) -> DataFrame:
        return self._of("card", F.col("id").alias("card_id"), "status", F.col("version").alias("revision"), F.col("hash").alias("card_hash"))

    @property
    def refused(self) -> DataFrame:
        return self._of("refused", "commit", "seq", "kind", "id", "problem")


def shaped(actions: DataFrame) -> DataFrame:
    """Actions with every column (missing ones null) and their place: commit and seq."""
    kinds = dict(c.strip().split(" ", 1) for c in ACTION.split(", ")) | {"commit": "long", "seq": "int"}
    return actions.select(*[F.col(c).cast(t).alias(c) if c in actions.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])


def replay(actions: DataFrame) -> State:
    """The state of every workspace; the fold runs once and is kept in the shared folder."""
    rows = shaped(actions).repartition("workspace").sortWithinPartitions("workspace", "commit", "seq")
    return State(store.kept(rows.mapInPandas(_fold, OUT), "ledger-state"))
