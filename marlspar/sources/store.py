"""Small objects of a shared folder that appear at once and never replace one another."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or a temporary folder of a local session (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if root is None:
        global _LOCAL
        _LOCAL = root = _LOCAL or "file://" + tempfile.mkdtemp(prefix="marlspar-store-")
    return root.rstrip("/")


_LOCAL: str | None = None


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def _hadoop(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, uri: str, data: bytes) -> bool:
    """Write an object whole unless it exists; False if it does. Of concurrent writers one succeeds.

    On a local folder a finished file is linked to its name; elsewhere Hadoop's create without overwriting decides.
    """
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        try:
            os.link(part, path)
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        return True
    from py4j.protocol import Py4JJavaError

    name, store = _hadoop(spark, uri)
    try:
        out = store.create(name, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise
    try:
        out.write(data)
    finally:
        out.close()
    return True


def get(spark: SparkSession, uri: str) -> bytes | None:
    """An object's bytes; None if there is none."""
    path = _local(uri)
    if path is not None:
        try:
            with open(path, "rb") as f:
                return f.read()
        except (FileNotFoundError, NotADirectoryError):
            return None
    name, store = _hadoop(spark, uri)
    if not store.exists(name):
        return None
    stream = store.open(name)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    path = _local(folder)
    if path is not None:
        return sorted(n for n in os.listdir(path) if not n.endswith(".part")) if os.path.isdir(path) else []
    name, store = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(name)) if store.exists(name) else []


def remove(spark: SparkSession, uri: str) -> None:
    """Delete an object or a folder; nothing happens if it is gone."""
    path = _local(uri)
    if path is not None and not os.path.isdir(path):
        with contextlib.suppress(FileNotFoundError):
            os.unlink(path)
        return
    name, store = _hadoop(spark, uri)
    store.delete(name, True)


def kept(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read back: what several later steps read is made once."""
    path = f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
