"""A persistent BM25 index: posting blocks in Parquet, bucketed by token, found again by the catalog's fingerprint.

A block holds a token's postings within one group of some BLOCK entries (dealt by hash, so a token that every entry has
is many blocks), the greatest count and the least length among them, which bound the score that any of them can give. Entries
are shuffled once, as texts by group, and their blocks written where they are counted: postings are never shuffled. A search reads the buckets of its tokens only. Queries of
up to MAX_QUERY_TOKENS tokens go to every task: each block is read once, dealt by group and scored against all queries as
products of matrices, and a task hands on the best of each query. More queries are joined: from the blocks' heads a search
bounds every group of entries from above for each query, scores the most promising groups to learn a score that the
result's last place has at least, and then only those groups whose bound reaches it.

Payloads of entries lie in their own buckets by id, so wide columns are read for the entries of a result alone. An
index is a folder of its own; a small object named after the fingerprint publishes it when it is complete. Of two
builders one publishes and the other uses its index. Where nothing can be written, a scan of the entries answers instead.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import retrieval
from . import store

SCHEMA = 2
#: Entries of one group at the mean.
BLOCK = 64
#: Buckets of tokens and of payloads; a search names the buckets that it reads.
BUCKETS = 64
#: Entries that one task of a search scores, or of a build counts, at the mean; bytes of text of the latter.
TASK, TASK_BYTES = 16_384, 64 << 20
#: Entries whose postings a task counts, and blocks that it scores, at once, at least.
COUNTED, SCORED = 1024, 1 << 16
#: The bucket of what a build has counted.
SUMS = -1


def fingerprint(rows: DataFrame, extensions: dict | None = None) -> str:
    """Changes with the schema of the index, a policy's vocabulary and the rows' contents, whatever their order."""
    each = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in sorted(rows.columns)])
    sums = rows.select(each.alias("a"), F.xxhash64(each, F.lit(7)).alias("b")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "ab"]).first()
    return hashlib.sha256(json.dumps([SCHEMA, extensions or {}, sums["n"], str(sums["a"]), str(sums["b"])], sort_keys=True).encode()).hexdigest()


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    """An index that is complete."""

    spark: SparkSession
    folder: str
    entry_count: int
    mean: float
    _read: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def _table(self, name: str) -> DataFrame:
        """A part of the index; its folders are listed once."""
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}")
        return self._read[name]

    def _terms(self, name: str, wanted: list[int] | None) -> DataFrame:
        rows = self._table(name)
        return rows if wanted is None else rows.where(F.col("bucket").isin(wanted))

    def rank(self, queries: DataFrame, top: int) -> DataFrame:
        """(query, entry, score, rank) of the best `top` entries with score > 0; queries has (query, token, qtf)."""
        asked = queries.select("query", "token", "qtf")
        small = asked.limit(retrieval.MAX_QUERY_TOKENS + 1).count() <= retrieval.MAX_QUERY_TOKENS
        wanted = [r[0] for r in asked.select(_bucket(F.col("token"))).distinct().collect()] if small else None
        n = F.lit(float(self.entry_count))
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * (1 + retrieval.QUERY_FACTOR * F.log1p(F.col("qtf")))
        weighed = asked.join(self._terms("terms", wanted), "token").select("query", "token", weight.alias("w"))
        if small:
            return self._rank_blocks(weighed, queries, wanted, top)
        side = weighed
        heads = self._terms("blocks", wanted).select("token", "group", _part(F.col("most"), F.col("least"), self.mean).alias("best")).join(side, "token")
        bounds = heads.groupBy("query", "group").agg(F.sum(F.col("w") * F.col("best")).alias("bound"))
        order = Window.partitionBy("query").orderBy(F.desc("bound"), "group")
        # each of these groups has one hit at least
        first = bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).select("query", "group", F.lit(True).alias("seen"))
        least = self._scored(first, side, wanted).withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"))))
        floor = least.where(F.col("r") == top).select("query", F.col("score").alias("floor"))
        # bounds and scores are sums of the same products in any order
        left = bounds.join(floor, "query", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-6)).select("query", "group")
        place = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "entry")
        return self._scored(left, side, wanted).where("score > 0").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)

    def _rank_blocks(self, weighed: DataFrame, queries: DataFrame, wanted: list[int], top: int) -> DataFrame:
        """`rank` for queries that every task holds; blocks are shuffled once, whatever the number of queries."""
        asked = weighed.collect()
        blocks = self._table("blocks")
        kinds = queries.schema["query"].dataType.simpleString(), blocks.schema["hits"].dataType.elementType["entry"].dataType.simpleString()
        if not asked:
            return self.spark.createDataFrame([], f"query {kinds[0]}, entry {kinds[1]}, score double, rank int")
        names, vocabulary = [*dict.fromkeys(r["query"] for r in asked)], {w: k for k, w in enumerate(dict.fromkeys(r["token"] for r in asked))}
        place = {n: k for k, n in enumerate(names)}
        side = self.spark.sparkContext.broadcast((np.array([(vocabulary[r["token"]], place[r["query"]]) for r in asked], np.int64), np.array([r["w"] for r in asked])))
        numbers = self.spark.createDataFrame([*vocabulary.items()], "token string, number long")
        tasks = max(self.spark.sparkContext.defaultParallelism, self.entry_count // TASK)
        dealt = self._terms("blocks", wanted).select("token", "group", "hits").join(F.broadcast(numbers), "token").select("group", "number", "hits").repartition(tasks, "group").sortWithinPartitions("group")
        known, mean = len(vocabulary), self.mean

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (token, query), weight = side.value[0].T, side.value[1]
            tables = retrieval.query_blocks(token, query, weight, len(names), known)
            best: dict[int, list] = {}
            for rows in _whole_groups(batches, SCORED):
                hits = rows.column("hits")
                flat, size = hits.flatten(), pc.list_value_length(hits).to_numpy(zero_copy_only=False)
                entry = flat.field("entry").dictionary_encode()
                number = np.repeat(rows.column("number").to_numpy(zero_copy_only=False), size)
                part = _part(*[flat.field(c).to_numpy(zero_copy_only=False) for c in ("tf", "dl")], mean)
                retrieval.keep_best(best, tables, entry.dictionary, entry.indices.to_numpy(zero_copy_only=False).astype(np.int64), number, part, top)
            out = [(names[k], e, s) for k, found in best.items() for _, e, s in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["query", "entry", "score"])

        place_of = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "entry")
        found = dealt.mapInArrow(score, f"query {kinds[0]}, entry {kinds[1]}, score double")
        return found.withColumn("rank", F.row_number().over(place_of)).where(F.col("rank") <= top)

    def _scored(self, chosen: DataFrame, side: DataFrame, wanted: list[int] | None) -> DataFrame:
        """(query, entry, score) of all hits within the chosen (query, group)."""
        blocks = self._terms("blocks", wanted).select("token", "group", "hits").join(side, "token").join(chosen, ["query", "group"])
        hit = blocks.select("query", "w", F.explode("hits").alias("h"))
        return hit.groupBy("query", F.col("h.entry").alias("entry")).agg(F.sum(F.col("w") * _part(F.col("h.tf"), F.col("h.dl"), self.mean)).alias("score"))

    def entries(self, ids: DataFrame, key: str = "entry", columns: list[Column | str] | None = None) -> DataFrame:
        """Payloads of the ids in column `key`, or `columns` made of them before any shuffle; the buckets of at most MAX_QUERY_TOKENS ids are named to the scan."""
        own = ids.select(F.col(key).alias("_key")).distinct()
        rows = self._table("entries")
        if own.limit(retrieval.MAX_QUERY_TOKENS + 1).count() <= retrieval.MAX_QUERY_TOKENS:
            rows = rows.where(F.col("_bucket").isin([r[0] for r in own.select(_bucket(F.col("_key"))).distinct().collect()]))
            own = F.broadcast(own)
        rows = rows if columns is None else rows.select("_bucket", "_entry", *columns)
        return rows.join(own, F.col("_entry") == F.col("_key"), "left_semi").drop("_bucket", "_entry")


def _part(tf, dl, mean: float):
    """What a posting adds to a score but for its token's weight; grows with tf, falls with dl. Of columns or arrays."""
    return tf * (retrieval.K1 + 1) / (tf + retrieval.K1 * (1 - retrieval.B + retrieval.B * dl / mean))


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of group, cut where a group ends and `least` rows or more have come."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        group = batch.column("group").to_numpy(zero_copy_only=False)
        before = held[-1].column("group")[-1].as_py() if held else None
        ends = np.flatnonzero(group[1:] != group[:-1]) + 1
        if before is not None and len(group) and group[0] != before:
            ends = np.concatenate([[0], ends])
        at, waiting = 0, sum(map(len, held))
        for cut in ends.tolist():
            if waiting + cut - at >= least:
                yield pa.concat_batches([*held, batch.slice(at, cut - at)])
                at, waiting, held = cut, 0, []
        if at < len(group):
            held.append(batch.slice(at))
    if held:
        yield pa.concat_batches(held)


def _counted() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of the entries' tokens, from rows (group, entry, said) in order of group; a row without a token has the sums of some entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, COUNTED):
            said, ids = rows.column("said"), rows.column("entry").dictionary_encode()
            entry = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            entries = len(ids.dictionary)
            group = np.zeros(entries, np.int64)
            group[entry] = rows.column("group").to_numpy(zero_copy_only=False)
            fields = said.flatten()
            row = np.repeat(entry, pc.fill_null(pc.list_value_length(said), 0).to_numpy(zero_copy_only=False))
            tokens, weight = fields.field("t"), fields.field("w").to_numpy(zero_copy_only=False)
            size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            words = tokens.flatten().dictionary_encode()
            row, weight = np.repeat(row, size), np.repeat(weight, size)
            length = np.bincount(row, weights=weight, minlength=entries)
            # all rows of an entry are here, in one group
            place = np.unique(group, return_inverse=True)[1]
            known = max(1, len(words.dictionary))
            key, back = np.unique((place[row] * known + words.indices.to_numpy(zero_copy_only=False)) * entries + row, return_inverse=True)
            tf, who, block = np.bincount(back, weights=weight, minlength=len(key)), key % entries, key // entries
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
            at = who[first]
            sums = pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0]), pa.array([float(length.sum())]), pa.array([float((length > 0).sum())]), pa.array([None], _hits(ids.dictionary.type))], BLOCKS)
            yield sums
            if len(first):
                hit = pa.StructArray.from_arrays([ids.dictionary.take(pa.array(who)), pa.array(tf), pa.array(length[who])], ["entry", "tf", "dl"])
                hits = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), hit)
                token = words.dictionary.take(pa.array(block[first] % known))
                yield pa.RecordBatch.from_arrays([token, pa.array(group[at]), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(length[who], first)), hits], BLOCKS)

    return run


BLOCKS = ["token", "group", "most", "least", "hits"]


def _hits(entry: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct([("entry", entry), ("tf", pa.float64()), ("dl", pa.float64())]))


@dataclass
class Scan:
    """The same answers from a scan of the entries, where no index can be written."""

    rows: DataFrame
    entry: str
    fields: Column
    entry_count: int

    def rank(self, queries: DataFrame, top: int) -> DataFrame:
        return retrieval.bm25_scan(retrieval.tokenised(self.rows, self.entry, self.fields), queries, top)

    def entries(self, ids: DataFrame, key: str = "entry", columns: list[Column | str] | None = None) -> DataFrame:
        found = self.rows.withColumn("_entry", F.col(self.entry)).join(ids.select(F.col(key).alias("_key")).distinct(), F.col("_entry") == F.col("_key"), "left_semi")
        return found.drop("_entry") if columns is None else found.select(*columns)


def _firsts(rows: DataFrame, keys: list[str], order: list[Column] | None) -> DataFrame:
    """The first row of each key; all rows without an order."""
    return rows if order is None else rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def build(rows: DataFrame, entry: str, fields: Column, folder: str, order: list[Column] | None = None) -> dict:
    """Writes all parts of an index into a new folder; what has to be published. With `order` the first row of each entry counts."""
    spark = rows.sparkSession
    every = rows.where(F.col(entry).isNotNull())
    held = _firsts(every, [entry], order)  # the payloads are not read for the postings
    kind = rows.schema[entry].dataType.simpleString()
    long = held.select(F.col(entry).alias("entry"), F.transform(fields, lambda f: F.struct(f["text"].alias("text"), f["weight"].cast("double").alias("w"))).alias("fields"))
    heavy = F.aggregate("fields", F.lit(0).cast("long"), lambda a, f: a + F.coalesce(F.octet_length(f["text"]), F.lit(0)))
    about = long.agg(F.count(F.lit(1)).alias("rows"), F.sum(heavy).alias("bytes")).first()
    group = F.pmod(F.xxhash64("entry"), F.lit(max(1, -(-about["rows"] // BLOCK))))
    tasks = max(spark.sparkContext.defaultParallelism, about["rows"] // TASK, (about["bytes"] or 0) // TASK_BYTES)
    dealt = long.withColumn("group", group).repartition(tasks, "group").sortWithinPartitions("group")
    said = F.transform("fields", lambda f: F.struct(text.tokens(f["text"]).alias("t"), f["w"].alias("w")))
    blocks = dealt.select("group", "entry", said.alias("said")).mapInArrow(_counted(), f"token string, group long, most double, least double, hits array<struct<entry: {kind}, tf: double, dl: double>>")
    blocks = blocks.withColumn("bucket", F.when(F.col("token").isNull(), SUMS).otherwise(_bucket(F.col("token"))))
    blocks.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{folder}/blocks")
    written = spark.read.parquet(f"{folder}/blocks")
    sums = written.where(F.col("bucket") == SUMS).agg(F.sum("least").cast("long").alias("n"), F.sum("most").alias("total")).first()
    if not sums["n"]:
        return {"schema": SCHEMA, "folder": folder, "entry_count": 0, "mean": 1.0}
    n, mean = sums["n"], max(1.0, sums["total"] / sums["n"])
    terms = written.where(F.col("bucket") != SUMS).groupBy("bucket", "token").agg(F.sum(F.size("hits")).alias("df"))
    terms.repartition("bucket").sortWithinPartitions("token").write.partitionBy("bucket").parquet(f"{folder}/terms")
    wide = every.withColumn("_entry", F.col(entry)).withColumn("_bucket", _bucket(F.col(entry))).withColumn("_part", F.pmod(F.xxhash64("_entry", F.lit(1)), F.lit(4)))
    # an entry's rows lie in one part: the same shuffle serves its first row and the files
    dealt = _firsts(wide.repartition("_bucket", "_part"), ["_bucket", "_part", "_entry"], order)
    dealt.drop("_part").write.partitionBy("_bucket").parquet(f"{folder}/entries")
    return {"schema": SCHEMA, "folder": folder, "entry_count": n, "mean": mean}


def opened(spark: SparkSession, root: str, mark: str) -> Index | None:
    """The published index of a fingerprint; None if there is none, or one of another schema or without entries."""
    raw = store.get(spark, f"{root}/{mark}.json")
    said = json.loads(raw) if raw else {}
    if said.get("schema") != SCHEMA or not said.get("entry_count"):
        return None
    return Index(spark, said["folder"], said["entry_count"], said["mean"])


def load_or_build(rows: DataFrame, entry: str, fields: Column, root: str, mark: str | None = None, refresh: bool = False, order: list[Column] | None = None) -> Index | Scan:
    """The index of `rows` (with `order`: of each entry's first row) below `root`, built unless one of this fingerprint is there (or refresh asks for a new one)."""
    spark = rows.sparkSession
    mark = mark or fingerprint(rows)
    if not refresh and (found := opened(spark, root, mark)):
        return found
    folder = f"{root}/{mark[:16]}-{uuid.uuid4().hex}"
    try:
        said = build(rows, entry, fields, folder, order)
        if not said["entry_count"]:
            store.remove(spark, folder)
            return Scan(_firsts(rows, [entry], order), entry, fields, 0)
        if refresh:
            store.remove(spark, f"{root}/{mark}.json")
        if not store.put_if_absent(spark, f"{root}/{mark}.json", json.dumps(said).encode()):
            store.remove(spark, folder)  # another builder was first
    except (OSError, PySparkException, Py4JJavaError) as e:
        warnings.warn(f"no index can be kept below {root} ({type(e).__name__}); entries are scanned instead", RuntimeWarning, stacklevel=2)
        only = _firsts(rows, [entry], order)
        return Scan(only, entry, fields, only.count())
    return opened(spark, root, mark) or Scan(_firsts(rows, [entry], order), entry, fields, 0)


def prune(spark: SparkSession, root: str, keep: str) -> list[str]:
    """Deletes what is below `root` but the index of fingerprint `keep`; the names of what went."""
    raw = store.get(spark, f"{root}/{keep}.json")
    own = {f"{keep}.json", json.loads(raw)["folder"].rsplit("/", 1)[-1]} if raw else {f"{keep}.json"}
    gone = [n for n in store.names(spark, root) if n not in own]
    for n in gone:
        store.remove(spark, f"{root}/{n}")
    return gone
