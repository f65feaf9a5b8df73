"""Folders as a data source that plans its own partitions: every name, hidden ones too, and what can't be written."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tagloom.sources.files import text_error

SCHEMA = "path string, size long, modified timestamp, kind string, readonly boolean, content binary"


@dataclass
class Branch(InputPartition):
    """A folder, and whether its folders belong to it or to partitions of their own."""

    folder: str
    deep: bool


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.content = options.get("content", "false").lower() == "true"
        self.endings = tuple(e for e in options.get("endings", "").lower().split(",") if e)
        self.levels = int(options.get("levels", "2"))

    def partitions(self) -> list[Branch]:
        """The folder, and below it every folder down to ``levels``: the deepest are read with all that is below them."""
        out, level = [Branch(self.root, False)], [self.root]
        for depth in range(self.levels if self.recursive else 0):
            level = sorted(e.path for folder in level for e in entries(folder) if e.is_dir(follow_symlinks=False))
            out += [Branch(folder, depth + 1 == self.levels) for folder in level]
        return out

    def read(self, partition: Branch) -> Iterator[tuple]:
        todo = [partition.folder]
        while todo:
            for entry in entries(todo.pop()):
                if entry.is_dir(follow_symlinks=False):
                    if partition.deep:
                        todo.append(entry.path)
                    elif self.wanted(entry.name):
                        yield self.row(entry, "folder")
                elif self.wanted(entry.name):
                    yield self.row(entry, "file" if entry.is_file() else "other")

    def wanted(self, name: str) -> bool:
        return not self.endings or name.lower().rpartition(".")[2] in self.endings

    def row(self, entry: os.DirEntry, kind: str) -> tuple:
        about = entry.stat()
        content = None
        if self.content and kind == "file":
            with open(entry.path, "rb") as file:
                content = file.read()
        return entry.path, about.st_size, datetime.fromtimestamp(about.st_mtime, timezone.utc), kind, not about.st_mode & (stat.S_IWUSR | stat.S_IWGRP | stat.S_IWOTH), content


def entries(folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as found:
            return list(found)
    except (FileNotFoundError, NotADirectoryError, PermissionError):  # a folder may go meanwhile
        return []


class FolderSource(DataSource):
    """spark.read.format("folder").load(path), with the options recursive, content, endings (comma-separated) and levels."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


def folder(spark: SparkSession, path: str, recursive: bool = True, content: bool = False, endings: tuple[str, ...] = ()) -> DataFrame:
    """All files of a folder that every executor can open; names that begin with . or _ are there like others."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").options(recursive=str(recursive), content=str(content), endings=",".join(endings)).load(path)


def checked_texts(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """path, error: why a text below the folder can't be edited, or null. wanted(path): these alone, missing ones among them."""
    rows = folder(spark, path, content=True)
    if wanted is not None:
        asked = wanted.select(F.col("path").alias("__p")).distinct()
        rows = asked.join(rows, F.col("path") == F.col("__p"), "left").withColumn("path", F.col("__p"))
    early = F.when(F.col("kind").isNull(), "missing").when(F.col("kind") != "file", "not a file")
    late = text_error(F.col("path"), F.coalesce("content", F.lit(b"")))
    error = early.when(late == "not a .txt file", late).when(F.col("readonly"), "read-only").otherwise(late)
    return rows.select("path", error.alias("error"))
