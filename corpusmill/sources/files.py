"""Artifact listings of a real directory tree, as a DataFrame ``(dir, name, mtime)``.

A Python data source: the driver lists the root alone, and each of its folders is a partition that a task
walks, so files are only seen by tasks. Files of zero bytes are files like any other; hidden ones (names that begin with
``.`` or ``_``) are left out, as in a scan. The tree is read through Arrow's file systems (local or shared mounts, HDFS, S3), so it
needs a path that they open.
"""

from __future__ import annotations

import fnmatch
import sys

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.glob = options["path"], options.get("glob", "*")
        self.recursive = options.get("recursive", "true") == "true"

    def _root(self) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.uri if ":" in self.uri else f"file://{self.uri}")
        return system, root.rstrip("/")

    def partitions(self) -> list[Folder]:
        """The root's own files, and one partition for each folder below it."""
        system, root = self._root()
        folders = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory] if self.recursive else []
        return [Folder(root, False), *(Folder(path, True) for path in sorted(folders) if _shown(path))]

    def read(self, folder: Folder):
        system, root = self._root()
        for f in system.get_file_info(fs.FileSelector(folder.path, recursive=folder.deep)):
            inner = f.path[len(root):].strip("/")
            if f.type == fs.FileType.File and all(map(_shown, inner.split("/"))) and fnmatch.fnmatchcase(f.base_name, self.glob):
                yield inner.rpartition("/")[0], f.base_name, f.mtime_ns / 1e9


def _shown(path: str) -> bool:
    return path.rpartition("/")[2][:1] not in (".", "_")


class ListingSource(DataSource):
    """``spark.read.format("artifact_listing").option("path", root).load()``"""

    @classmethod
    def name(cls) -> str:
        return "artifact_listing"

    def schema(self) -> str:
        return "dir string, name string, mtime double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def list_files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Every file under ``root`` matching ``glob`` (file-name pattern): ``dir`` relative to
    ``root`` ('' for the root itself), ``name``, ``mtime`` in epoch seconds."""
    spark.dataSource.register(ListingSource)
    return spark.read.format("artifact_listing").option("path", root.rstrip("/")).option("glob", glob) \
        .option("recursive", str(recursive).lower()).load()


# Python workers need not have this package installed: the source travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
