"""A folder's files as a table, listed and read in parallel: `spark.read.format("source_files").option("path", ...)`.

Every folder below the root is a partition of its own, the root's files another; excluded and hidden folders are pruned
before anything below them is looked at, and files beyond the size limit are not opened. The driver lists the root alone.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import vocab

SCHEMA = "path string, size long, content binary"
MAX_BYTES = 2_000_000


class _Folder(InputPartition):
    def __init__(self, folder: str, deep: bool):
        super().__init__(folder)
        self.folder, self.deep = folder, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str, most: int, excluded: set[str]):
        self.root, self.most, self.excluded = root, most, excluded

    def _descends(self, entry: os.DirEntry) -> bool:
        return entry.is_dir(follow_symlinks=False) and not entry.name.startswith(".") and entry.name.lower() not in self.excluded

    def partitions(self) -> list[InputPartition]:
        with os.scandir(self.root) as found:
            return [_Folder("", False), *(_Folder(e.name, True) for e in sorted(found, key=lambda e: e.name) if self._descends(e))]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        todo = [partition.folder]
        while todo:
            folder = todo.pop()
            try:
                with os.scandir(os.path.join(self.root, folder)) as found:
                    entries = sorted(found, key=lambda e: e.name)
            except OSError:  # gone, or not ours to read
                continue
            for e in entries:
                path = f"{folder}/{e.name}" if folder else e.name
                try:
                    if self._descends(e):
                        todo += [path] * partition.deep
                        continue
                    if e.name.startswith(".") or not e.is_file() or (size := e.stat().st_size) > self.most:
                        continue
                    if os.path.splitext(e.name)[1].lower() in vocab.BINARY_SUFFIXES:
                        continue
                    with open(e.path, "rb") as f:
                        yield path, size, f.read()
                except OSError:
                    continue


class SourceFiles(DataSource):
    """Options: path, maxFileBytes, excluded (further folder names, separated by commas)."""

    @classmethod
    def name(cls) -> str:
        return "source_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        more = {x.strip().lower() for x in self.options.get("excluded", "").split(",") if x.strip()}
        return _Reader(self.options["path"], int(self.options.get("maxFileBytes", MAX_BYTES)), more | {*vocab.SKIPPED_FOLDERS})


def source_files(spark: SparkSession, path: str, most: int = MAX_BYTES, excluded: list[str] | None = None) -> DataFrame:
    """(path, size, content) of a folder's files, paths relative to it."""
    spark.dataSource.register(SourceFiles)
    return spark.read.format("source_files").option("path", path).option("maxFileBytes", most).option("excluded", ",".join(excluded or [])).load()
