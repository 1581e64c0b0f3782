"""A ledger of actions as numbered commits in a shared folder.

A commit is one JSON object, a line for each action, written under the next free number only if that number is still free; a
writer that loses the race checks its actions against the new state and tries the next number. Nothing is ever replaced.
Every SNAPSHOT commits the actions up to there are also kept as one Parquet table, so that readers open few objects.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import replay
from . import store

#: Commits after which the actions so far are written together.
SNAPSHOT = 20
TRIES = 50


class RefusedActions(ValueError):
    """Actions that break a rule of the ledger; `problems` are (place in the commit, kind, id, problem)."""

    def __init__(self, problems: list[tuple]):
        super().__init__("; ".join(f"{kind} {i}: {p}" for _, kind, i, p in problems))
        self.problems = problems


class Ledger:
    """Actions of any number of workspaces below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def last(self) -> int:
        """The number of the last commit; 0 before the first."""
        found = store.names(self.spark, f"{self.root}/commits")
        return int(found[-1].split(".")[0]) if found else 0

    def _snapshot(self) -> tuple[int, str | None]:
        found = [n for n in store.names(self.spark, f"{self.root}/snapshots") if n.endswith(".json")]
        if not found:
            return 0, None
        return int(found[-1].split(".")[0]), json.loads(store.get(self.spark, f"{self.root}/snapshots/{found[-1]}"))["folder"]

    def actions(self, upto: int | None = None) -> DataFrame:
        """All actions with commit and seq, of commits up to a number."""
        upto = self.last() if upto is None else upto
        kept, folder = self._snapshot()
        parts = []
        if folder and kept <= upto:
            parts.append(self.spark.read.parquet(folder))
        else:
            kept = 0
        paths = [f"{self.root}/commits/{n:020d}.json" for n in range(kept + 1, upto + 1)]
        schema = f"{replay.ACTION}, commit long, seq int"
        if paths:
            parts.append(self.spark.read.schema(schema).json(paths))
        out = self.spark.createDataFrame([], schema) if not parts else parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def state(self) -> replay.State:
        return replay.replay(self.actions())

    def commit(self, *actions: dict) -> int:
        """Appends actions in one commit; its number. RefusedActions if one of them breaks a rule, then none is written."""
        names = {c.strip().split(" ")[0] for c in replay.ACTION.split(", ")}
        if unknown := {k for a in actions for k in a} - names:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        own = [a.get("workspace") for a in actions]
        for _ in range(TRIES):
            number = self.last() + 1
            lines = [json.dumps(a | {"commit": number, "seq": k}) for k, a in enumerate(actions)]
            before = self.actions(number - 1).where(F.col("workspace").isin([w for w in own if w is not None]))
            new = self.spark.createDataFrame([(x,) for x in lines], "value string").select(F.from_json("value", f"{replay.ACTION}, commit long, seq int").alias("a")).select("a.*")
            bad = replay.replay(before.unionByName(new)).refused.where(F.col("commit") == number).orderBy("seq").collect()
            if bad:
                raise RefusedActions([(r["seq"], r["kind"], r["id"], r["problem"]) for r in bad])
            if store.put_if_absent(self.spark, f"{self.root}/commits/{number:020d}.json", "\n".join(lines).encode()):
                if number % SNAPSHOT == 0:
                    self._keep(number)
                return number
        raise TimeoutError(f"{TRIES} other commits came first")

    def _keep(self, number: int) -> None:
        folder = f"{self.root}/snapshots/{number:020d}-{uuid.uuid4().hex}"
        self.actions(number).repartition("workspace").write.parquet(folder)
        if not store.put_if_absent(self.spark, f"{self.root}/snapshots/{number:020d}.json", json.dumps({"folder": folder}).encode()):
            store.remove(self.spark, folder)
