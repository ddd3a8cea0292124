"""Source trees as a Spark data source: folders are planned on the driver, files are listed and read by tasks.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").option("globs", "**/*_pb2.py").load(root)

The driver walks folders only and holds their names, never those of files. Each
partition is some folders; its task lists them, filters names and reads contents
one file at a time. The path must be reachable from all executors.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from symbolake.functions import glob_regex
from symbolake.model import LANGUAGES
from symbolake.plans.ranking import ranked
from symbolake.plans.workspace import written
from symbolake.sources.tree import CONTENT, SKIPPED, ignore_globs, path_order, read_files

#: Folders that one task lists.
FOLDERS = 64


@dataclass
class Folders(InputPartition):
    names: tuple[str, ...]


class TreeReader(DataSourceReader):
    def __init__(self, root: str, globs: list[str], folders: int, contents: bool):
        self.root, self.globs, self.folders, self.contents = root, globs, folders, contents

    def partitions(self) -> list[Folders]:
        found: list[str] = []
        for folder, inner, _ in os.walk(self.root):
            inner[:] = sorted(d for d in inner if d not in SKIPPED)
            found.append(os.path.relpath(folder, self.root))
        return [Folders(tuple(found[i : i + self.folders])) for i in range(0, len(found), self.folders)] or [Folders(())]

    def read(self, partition: Folders) -> Iterator[tuple[str, str, bytes | None]]:
        rules = [re.compile(glob_regex(g).replace(r"\z", r"\Z")) for g in self.globs]
        for folder in partition.names:
            with os.scandir(Path(self.root, folder)) as entries:
                names = sorted(e.name for e in entries if os.path.splitext(e.name)[1] in LANGUAGES and e.is_file())
            for name in names:
                rel = name if folder == "." else f"{folder}/{name}"
                if not any(r.match(rel) for r in rules):
                    yield rel, os.path.splitext(name)[1], Path(self.root, rel).read_bytes() if self.contents else None


class SourceTree(DataSource):
    """Files of the supported languages: file, ext and content.

    Options: path; globs, one a line; folders, for each task; contents, ``false`` for names only.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "file string, ext string, content binary"

    def reader(self, schema) -> TreeReader:
        root = self.options["path"]
        globs = [g for g in self.options.get("globs", "").split("\n") if g]
        return TreeReader(root, globs, int(self.options.get("folders", FOLDERS)), self.options.get("contents", "true") == "true")


def write_tree(files: DataFrame, root: str | Path) -> None:
    """Write (file, content) rows as files under a root, by the tasks that hold them."""
    top = str(root)

    def write(rows) -> None:
        for r in rows:
            path = Path(top, r["file"])
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(r["content"] or b"")

    files.select("file", "content").foreachPartition(write)


def read_tree(spark: SparkSession, root: str | Path, globs=(), folders: int = FOLDERS) -> DataFrame:
    """ord, file, ext, content and sha256 of every supported file under ``root``, as ``tree.read_tree`` gives them, listed by tasks."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("globs", "\n".join(ignore_globs(root, globs))).option("folders", folders).option("contents", "false")
    names = written(reader.load(str(root)).select("file"), "listing")  # listed once; places and contents follow from it
    places = ranked(names, path_order(F.col("file")), "ord")
    return places.select("ord", "file").mapInArrow(read_files(str(root)), CONTENT).withColumn("sha256", F.sha2("content", 256))
