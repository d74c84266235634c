"""Stored tables that change: folders that never change, and numbered manifests that list them.

A reader takes the newest manifest and sees that state whole, whatever is
written meanwhile. A writer adds folders first and then a manifest; the name of
the next manifest can be taken once, so of two writers one fails and nothing is
half done. Folders that no manifest lists belong to jobs that did not end;
``vacuum`` removes them with the manifests that are too old.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: The folder level that tells the writes of a table apart.
WRITE = "write_id"


class CommitConflict(RuntimeError):
    """Another writer has taken the version."""


@dataclass
class Manifest:
    """A state of the table: its folders, its columns, and what its writers note."""

    version: int = -1
    folders: list[str] = field(default_factory=list)
    schema: dict | None = None
    info: dict[str, Any] = field(default_factory=dict)


class VersionedTable:
    """A table below ``root``, a path of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        files, path = self._files(), self._path(folder)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    @staticmethod
    def _manifest_name(version: int) -> str:
        return f"_manifests/{version:012d}.json"

    # states

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("_manifests") if n.endswith(".json") and not n.startswith((".", "_"))]

    def manifest(self, version: int | None = None) -> Manifest:
        """A state, the newest by default; an empty one before the first commit."""
        known = self.versions()
        if version is None:
            if not known:
                return Manifest()
            version = known[-1]
        stream = self._files().open(self._path(self._manifest_name(version)))
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def read(self, manifest: Manifest | None = None, folders: list[str] | None = None) -> DataFrame:
        """The rows of a state, or of some of its folders; an error before the first commit of columns."""
        manifest = manifest or self.manifest()
        if manifest.schema is None:
            raise ValueError(f"{self.root} has no rows yet")
        schema = StructType.fromJson(manifest.schema)
        folders = manifest.folders if folders is None else folders
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/data/{f}" for f in folders]
        return self.spark.read.schema(schema.add(WRITE, "string")).option("basePath", f"{self.root}/data").parquet(*paths).drop(WRITE)

    # changes

    def write(self, df: DataFrame, partition_by: str | None = None, **options: str) -> list[str]:
        """Write rows to new folders, one per value of ``partition_by``; nothing reads them before a commit."""
        name = f"{WRITE}={uuid.uuid4().hex}"
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.options(**options).parquet(f"{self.root}/data/{name}")
        if partition_by is None:
            return [name]
        return [f"{name}/{n}" for n in self._names(f"data/{name}") if "=" in n]

    def commit(self, after: Manifest, folders: list[str], schema: StructType, info: dict[str, Any]) -> Manifest:
        """Make a new state that follows ``after``; raises ``CommitConflict`` if another one does already."""
        made = Manifest(after.version + 1, folders, json.loads(schema.json()), info)
        hadoop, files = self.spark._jvm.org.apache.hadoop.fs, self._files()
        draft, final = self._path(f"_manifests/.{uuid.uuid4().hex}"), self._path(self._manifest_name(made.version))
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(made.__dict__).encode()))
        out.close()
        context = hadoop.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.NONE
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(final), options)
        except Exception as error:
            files.delete(draft, False)
            if files.exists(final):
                raise CommitConflict(f"{self.root} is at version {made.version} already") from error
            raise
        return made

    def replace(self, after: Manifest, df: DataFrame, info: dict[str, Any]) -> Manifest:
        """A new state of these rows alone."""
        return self.commit(after, self.write(df), df.schema, info)

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the newest ``keep`` states and every folder that these do not list; folders removed.

        Only one writer may be at work, and readers of older states must have ended.
        """
        versions = self.versions()
        if not versions:
            return 0
        kept = {f for v in versions[-keep:] for f in self.manifest(v).folders}
        files, removed = self._files(), 0
        for v in versions[:-keep]:
            files.delete(self._path(self._manifest_name(v)), False)
        for write in self._names("data"):
            if write in kept:
                continue
            parts = [f"{write}/{n}" for n in self._names(f"data/{write}") if "=" in n]
            gone = [p for p in parts if p not in kept]
            for folder in [write] if len(gone) == len(parts) else gone:
                files.delete(self._path(f"data/{folder}"), True)
                removed += 1
        return removed


def rows_of(table: VersionedTable, schema: StructType, manifest: Manifest | None = None) -> DataFrame:
    """The rows of a state, none before the first commit."""
    manifest = manifest or table.manifest()
    return table.read(manifest) if manifest.schema is not None else table.spark.createDataFrame([], schema)


def partition_value(folder: str) -> str:
    """The value that a folder of a partitioned write holds."""
    return folder.rpartition("/")[2].partition("=")[2]
