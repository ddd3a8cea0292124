"""Source trees as DataFrames.

Spark's file readers skip names that begin with ``_`` or ``.``; trees are
therefore listed on the driver (names only, unwanted folders are never entered)
and file contents are read by the executors.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolake.functions import glob_regex
from symbolake.model import LANGUAGES

# Folders that are never scanned.
SKIPPED = (".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".mypy_cache", ".pytest_cache", ".ruff_cache", "target", ".next", ".idea", ".vscode", "vendor", ".claude")
IGNORE_FILE = ".symbolakeignore"

CONTENT = "ord long, file string, ext string, content binary"


def ignore_globs(root: str | Path, given: Sequence[str] = (), name: str = IGNORE_FILE) -> list[str]:
    """The given globs and those of the tree's ignore file, if it has one."""
    path = Path(root) / name
    lines = path.read_text(encoding="utf-8").splitlines() if path.is_file() else []
    return [*given, *(s for s in map(str.strip, lines) if s and s[0] != "#")]


def skipped(file: Column, globs: Sequence[str] = ()) -> Column:
    """Whether a relative path lies in a skipped folder or matches a glob."""
    parts = F.split(file, "/")
    out = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, SKIPPED)))
    for g in globs:
        out = out | file.rlike(rf"\A(?:{glob_regex(g)})")  # rlike finds, a glob matches whole paths
    return out


def _names(root: Path, globs: Sequence[str]) -> Iterator[str]:
    rules = [re.compile(glob_regex(g).replace(r"\z", r"\Z")) for g in globs]
    for folder, folders, names in os.walk(root):
        folders[:] = [d for d in folders if d not in SKIPPED]
        for name in names:
            path = Path(folder, name)
            rel = path.relative_to(root).as_posix()
            if path.suffix in LANGUAGES and path.is_file() and not any(r.match(rel) for r in rules):
                yield rel


def listing(root: str | Path, globs: Sequence[str] = ()) -> list[str]:
    """Relative paths of the supported files, ordered by path components."""
    return sorted(_names(Path(root), [*globs]), key=lambda rel: rel.split("/"))


def read_files(root: str):
    """Reads (ord, file) rows' contents under a root, one file at a time."""
    def run(batches):
        for batch in batches:
            for ord_, rel in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = Path(root, rel).read_bytes()
                yield pa.RecordBatch.from_pydict({"ord": pa.array([ord_], pa.int64()), "file": [rel], "ext": [os.path.splitext(rel)[1]], "content": pa.array([data], pa.binary())})

    return run


def read_tree(spark: SparkSession, root: str | Path, globs: Sequence[str] = (), files_per_task: int = 200) -> DataFrame:
    """ord, file, ext, content and sha256 of every supported file under ``root``."""
    names = listing(root, ignore_globs(root, globs))
    table = spark.createDataFrame([*enumerate(names)], "ord long, file string")
    table = table.repartition(max(1, -(-len(names) // files_per_task)), "ord")
    return table.mapInArrow(read_files(str(root)), CONTENT).withColumn("sha256", F.sha2("content", 256))


def path_order(file: Column) -> Column:
    """A sort key, as a string, that orders paths by their components: nothing sorts before the end of one."""
    return F.replace(file, F.lit("/"), F.lit("\0"))
