"""The folder that the driver and all executors share, and worker imports."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

REPO = str(Path(__file__).resolve().parents[2])


#: Bytes of an Arrow batch that a Python worker holds; texts of any length come whole.
BATCH_BYTES = "4m"
#: Rows of ids and labels that a task writes at least, but for so few tasks.
TASK_ROWS, LEAST_TASKS = 1 << 18, 16
#: Workers are used again by later tasks: their allocators give freed blocks back to the system instead of keeping them.
ALLOCATORS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started, and take batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    env = spark.sparkContext.environment
    for name, value in ALLOCATORS.items():
        env.setdefault(name, value)
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in parts:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *parts])


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: spark.checkpoint.dir, or one of our own where it is unset (tests).

    The session's value is only read; a checkpoint directory is set on the context if none is set there.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if root is None and not current.isDefined() and not (sc.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if root is None:
        root = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="marlspar-shared-")
    if not current.isDefined():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, per: int = TASK_ROWS) -> DataFrame:
    """`df` in partitions that at most `rows` rows fill, where the shuffle's number of partitions is higher.

    Small steps then neither start a Python worker nor write a file for each of the shuffle's partitions.
    """
    return df.coalesce(max(LEAST_TASKS, -(-rows // per)))


def dropped(df: DataFrame) -> None:
    """Delete the folder of a table made by `stored` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder of the shared store through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class IdRanges:
    """A set of ids as sorted arrays of ranges in the shared folder; a task maps the ranges that its ids fall into.

    Where ids follow the order of the input's files, a task reads a share of the set that does not grow with it.
    """

    #: Ids of one range.
    RANGE = 1 << 20

    def __init__(self, folder: str, starts: list[tuple[int, int]]):
        self.folder, self.starts = folder, sorted(starts)
        self._maps: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return {"folder": self.folder, "starts": self.starts, "_maps": {}}

    @classmethod
    def write(cls, ids: DataFrame) -> IdRanges:
        """ids: one column of distinct 64-bit numbers. One row for each range (number, first id) comes back."""
        spark, folder, name = ids.sparkSession, scratch(ids.sparkSession, "ids"), ids.columns[0]

        def run(batches):
            kept = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
            own = np.sort(np.concatenate(kept)) if kept else np.empty(0, np.int64)
            if len(own):
                number = TaskContext.get().partitionId()
                put_bytes(folder, f"{number}.ids", own.astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array(own[:1], pa.int64())], ["number", "first"])

        ranges = max(1, -(-ids.count() // cls.RANGE))
        rows = ids.repartitionByRange(ranges, name).mapInArrow(run, "number long, first long").collect()
        return cls(folder, [(r["first"], r["number"]) for r in rows])

    def holds(self, ids: np.ndarray) -> np.ndarray:
        """Which ids are in the set."""
        out = np.zeros(len(ids), bool)
        if not self.starts or not len(ids):
            return out
        which = np.searchsorted(np.array([s for s, _ in self.starts], np.int64), ids, "right") - 1
        for k in np.unique(which[which >= 0]).tolist():
            if k not in self._maps:
                self._maps[k] = np.frombuffer(map_file(self.folder, f"{self.starts[k][1]}.ids"), "<i8")
            at = np.flatnonzero(which == k)
            place = np.minimum(np.searchsorted(self._maps[k], ids[at]), len(self._maps[k]) - 1)
            out[at] = self._maps[k][place] == ids[at]
        return out


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a plain path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def put_bytes(folder: str, name: str, data) -> None:
    """Write one object of the shared folder so that a retried task replaces it whole."""
    path = local_path(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, f"{path}/{name}")
        return
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{root}/{name}")


def map_file(folder: str, name: str):
    """A read-only memory map of one object; objects of remote stores are copied, mapped, then unlinked."""
    import mmap

    path = local_path(folder)
    if path is not None:
        with open(f"{path}/{name}", "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(f.fileno()).st_size else b""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{name}") as src, tempfile.TemporaryFile() as f:
        size = 0
        while block := src.read(1 << 22):
            size += f.write(block)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if size else b""
