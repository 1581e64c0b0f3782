"""The catalog of promoted cards, kept by changes.

Each version holds the entries that are new or changed since the one before and the ids of those that went, with sums over
the whole catalog (entries, linked, hashed, quality) carried on from the last version's. A refresh compares ids and hashes
only; entries are rolled up for changed cards alone. Versions are published by create-if-absent and never replaced; after
COMPACT versions one holds all entries again, so that readers open few tables.

Cases: no cards give an empty catalog; a refresh without changes writes nothing; a null hash counts as changed each time; an
id that occurs twice is refused; of concurrent refreshes one wins and the others compare anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

COMPACT = 20
TRIES = 20
_KEYS = ["card_id", "card_hash"]


class Library:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _version(self) -> tuple[int, dict]:
        found = store.names(self.spark, f"{self.root}/versions")
        if not found:
            return 0, {"tables": [], "entries": 0, "linked": 0, "hashed": 0, "quality": 0}
        return int(found[-1].split(".")[0]), json.loads(store.get(self.spark, f"{self.root}/versions/{found[-1]}"))

    def _read(self, tables: list[str]) -> DataFrame | None:
        rows = None
        for k, path in enumerate(tables):
            own = self.spark.read.parquet(path).withColumn("_version", F.lit(k))
            rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        if rows is None:
            return None
        newest = F.row_number().over(Window.partitionBy("card_id").orderBy(F.desc("_version")))
        return rows.withColumn("_n", newest).where("_n = 1 and not _gone").drop("_n", "_version", "_gone")

    def entries(self) -> DataFrame:
        """All entries of the last version."""
        rows = self._read(self._version()[1]["tables"])
        return self.spark.createDataFrame([], "card_id string, card_hash string, source_url string, quality_score int") if rows is None else rows

    def stats(self) -> dict:
        """entries, linked (with a source), hashed, quality (sum) and the share of linked entries."""
        return _shares(self._version()[1])

    def refresh(self, cards: DataFrame, roll_up: Callable[[DataFrame], DataFrame]) -> dict:
        """Makes the catalog that of these cards (card_id, card_hash); `roll_up` gives the entries of the changed ones it is handed."""
        if cards.groupBy("card_id").count().where("count > 1").limit(1).count():
            raise ValueError("a card id occurs twice")
        for _ in range(TRIES):
            number, last = self._version()
            old = self.entries()
            changed = store.kept(cards.select(*_KEYS).join(old.select(*_KEYS), _KEYS, "left_anti"), "library-changed")
            gone = store.kept(old.select("card_id").join(cards, "card_id", "left_anti"), "library-gone")
            if not changed.limit(1).count() and not gone.limit(1).count():
                return _shares(last)
            path = f"{self.root}/entries/{uuid.uuid4().hex}"
            new = roll_up(changed).withColumn("_gone", F.lit(False))
            new.unionByName(gone.select("card_id", F.lit(True).alias("_gone")), allowMissingColumns=True).write.parquet(path)
            delta = self.spark.read.parquet(path)
            left = old.join(delta.select("card_id"), "card_id", "left_semi")
            plus, minus = _sums(delta.where("not _gone")), _sums(left)
            state = {k: last[k] + plus[k] - minus[k] for k in plus} | {"tables": [*last["tables"], path]}
            if len(state["tables"]) > COMPACT:
                whole = f"{self.root}/entries/{uuid.uuid4().hex}"
                self._read(state["tables"]).withColumn("_gone", F.lit(False)).write.parquet(whole)
                state["tables"] = [whole]
            if store.put_if_absent(self.spark, f"{self.root}/versions/{number + 1:020d}.json", json.dumps(state).encode()):
                return _shares(state)
        raise TimeoutError(f"{TRIES} other refreshes came first")


def _sums(rows: DataFrame) -> dict:
    filled = lambda x: F.count_if(F.coalesce(F.col(x), F.lit("")) != "")
    r = rows.agg(F.count(F.lit(1)).alias("entries"), filled("source_url").alias("linked"), filled("card_hash").alias("hashed"), F.coalesce(F.sum("quality_score"), F.lit(0)).alias("quality")).first()
    return {k: int(v) for k, v in r.asDict().items()}


def _shares(state: dict) -> dict:
    sums = {k: state[k] for k in ("entries", "linked", "hashed", "quality")}
    return sums | {"linked_share": sums["linked"] / sums["entries"] if sums["entries"] else None}


def problems(stats: dict, least: float = 0.95) -> list[str]:
    """What keeps a catalog from being published."""
    out = [] if stats["entries"] == 0 or stats["linked_share"] >= least else [f"{stats['linked']} of {stats['entries']} entries have a source"]
    return out if stats["hashed"] == stats["entries"] else [*out, f"{stats['entries'] - stats['hashed']} entries have no content hash"]
