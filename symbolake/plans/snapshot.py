"""Snapshots of a source tree: built incrementally, stored as Parquet, exchanged as JSON."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolake.functions import number, text
from symbolake.model import CALLS, EDGE_LANGUAGE, FILES, IMPORTS, LANGUAGES, SNAPSHOT_VERSION, SYMBOLS
from symbolake.operators import extract, lookup, trigrams
from symbolake.sources.tree import read_tree

TABLES = {"files": FILES, "symbols": SYMBOLS, "imports": IMPORTS, "calls": CALLS}


@dataclass
class Snapshot:
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    calls: DataFrame
    root: str = ""
    schema_version: int = SNAPSHOT_VERSION
    parser: str = "auto"
    held: list[DataFrame] = field(default_factory=list)
    #: Where the tables are stored, if they are.
    path: str = ""

    def release(self) -> None:
        """Let go of what ``build`` keeps in storage while the tables are written."""
        while self.held:
            self.held.pop().unpersist()

    def register(self, prefix: str = "") -> None:
        """Make the tables available to SQL."""
        for name in TABLES:
            getattr(self, name).createOrReplaceTempView(f"{prefix}{name}")


def split_unchanged(files: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with the same path and hash as before, and the others."""
    known = before.select("file", "sha256")
    return files.join(known, ["file", "sha256"], "left_semi"), files.join(known, ["file", "sha256"], "left_anti")


def build(spark: SparkSession, root: str | Path, globs: Sequence[str] = (), previous: Snapshot | None = None, parser: str = "auto") -> Snapshot:
    """Scan a tree; files unchanged since ``previous`` are not parsed again.

    A previous snapshot of another version or parser mode is not reused.
    """
    extract.backend(".py", parser)  # an unknown mode is an error
    files = read_tree(spark, root, globs).persist()
    names = [r[0] for r in files.select("ext").distinct().collect()]
    present = [e for e in LANGUAGES if e in names]
    for ext in present:
        extract.backend(ext, parser)  # a missing grammar is an error before any work
    if previous is not None and (previous.schema_version != SNAPSHOT_VERSION or previous.parser != parser):
        previous = None
    changed = files
    if previous is not None:
        _, changed = split_unchanged(files, previous.files)
    facts = extract.python_table(changed).persist()
    symbols = extract.symbols_of(facts)
    others = [e for e in present if e != ".py"]
    if others:
        symbols = symbols.unionByName(extract.generic_symbols(changed, parser, others))
    imports, calls = extract.imports_of(facts), extract.calls_of(facts)
    if previous is not None:
        same, _ = split_unchanged(files.select("file", "sha256", F.col("ord").alias("now")), previous.files)
        was = previous.files.select("file", F.col("ord").alias("was"))
        moved = same.select("file", "now").join(was, "file")
        # rows keep their place within the file and take the file's place of now
        old = previous.symbols.join(moved, "file").withColumn("ord", F.col("now") * extract.PER_FILE + F.col("ord") % extract.PER_FILE).drop("now", "was")
        symbols = symbols.unionByName(old.select(symbols.columns))
        imports = imports.unionByName(previous.imports.join(moved.select("file"), "file", "left_semi"))
        calls = calls.unionByName(previous.calls.join(moved.select("file"), "file", "left_semi").select(calls.columns))
    return Snapshot(files.select("file", "sha256", "ord"), symbols, imports, calls, str(root), SNAPSHOT_VERSION, parser, [files, facts])


def by_file(imports: DataFrame) -> DataFrame:
    """file and its modules, each once and in order."""
    return imports.groupBy("file").agg(F.array_sort(F.collect_set("module")).alias("modules"))


def by_section(symbols: DataFrame) -> DataFrame:
    """section, its first place and the number of its symbols: sections stand in order of their first symbol."""
    return symbols.groupBy("section").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("symbols"))


def export(snapshot: Snapshot) -> dict:
    """The JSON document: equal trees give equal bytes."""
    by_section: dict[str, list[dict]] = {}
    for r in snapshot.symbols.orderBy("ord").toLocalIterator():
        by_section.setdefault(r["section"], []).append({k: r[k] for k in ("name", "file", "line", "signature", "docstring", "language")})
    modules: dict[str, list[str]] = {}
    for r in by_file(snapshot.imports).orderBy("file").toLocalIterator():
        modules[r["file"]] = list(r["modules"])
    calls = [r.asDict() for r in snapshot.calls.select("file", "caller", "callee", "line").orderBy("file", "caller", "callee").toLocalIterator()]
    files = {r["file"]: r["sha256"] for r in snapshot.files.orderBy("ord").toLocalIterator()}
    return {"root": snapshot.root, "schema_version": SNAPSHOT_VERSION, "parser": snapshot.parser, "files": files, "symbols": by_section, "edges": {"language": EDGE_LANGUAGE, "imports": modules, "calls": calls}}


def from_document(spark: SparkSession, document: dict) -> Snapshot:
    """A snapshot from its JSON document; missing parts are empty, missing fields get defaults."""
    files = [(f, h, i) for i, (f, h) in enumerate((document.get("files") or {}).items())]
    symbols: list[tuple] = []
    for section, rows in (document.get("symbols") or {}).items():
        for r in rows:
            file = r.get("file") or ""
            symbols.append((section, r.get("name") or "", file, int(r.get("line") or 0), r.get("signature") or "", r.get("docstring") or "", r.get("language") or "", len(symbols)))
    edges = document.get("edges") or {}
    imports = [(f, m) for f, ms in (edges.get("imports") or {}).items() for m in ms]
    calls = [(c.get("file") or "", c.get("caller") or "", c.get("callee") or "", int(c.get("line") or 0)) for c in edges.get("calls") or []]
    make = spark.createDataFrame
    return Snapshot(make(files, FILES), make(symbols, SYMBOLS), make(imports, IMPORTS), make(calls, CALLS), document.get("root") or "", int(document.get("schema_version") or 0), document.get("parser") or "auto")


def placed(snapshot: Snapshot) -> Snapshot:
    """The snapshot with symbols numbered by file and by their order within it, as ``build`` numbers them."""
    within = F.row_number().over(Window.partitionBy("file").orderBy("line", "ord")) - 1
    at = snapshot.files.select("file", F.col("ord").alias("at"))
    symbols = snapshot.symbols.withColumn("k", within).join(at, "file", "left")
    symbols = symbols.withColumn("ord", F.coalesce("at", F.lit(1 << 30)) * extract.PER_FILE + F.col("k")).drop("at", "k")
    return Snapshot(snapshot.files, symbols, snapshot.imports, snapshot.calls, snapshot.root, snapshot.schema_version, snapshot.parser)


def save(snapshot: Snapshot, folder: str, find_index: bool = False) -> str:
    """Store the tables as Parquet under a new version of ``folder``; symbols are partitioned by section. Returns the version's path.

    ``find_index`` adds an index for substring searches, which holds the symbols once more.
    """
    path = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    for name in TABLES:
        writer = getattr(snapshot, name).write
        (writer.partitionBy("section") if name == "symbols" else writer).parquet(f"{path}/{name}")
    meta = "root string, schema_version int, parser string"
    spark = snapshot.files.sparkSession
    if find_index:
        trigrams.build(spark.read.schema(SYMBOLS).parquet(f"{path}/symbols"), path)
    # written last: a version without it is not complete
    spark.createDataFrame([(snapshot.root, SNAPSHOT_VERSION, snapshot.parser)], meta).withColumn("saved", F.current_timestamp()).coalesce(1).write.parquet(f"{path}/meta")
    return path


def newest(spark: SparkSession, folder: str) -> str | None:
    """The path of the last complete version in a store of snapshots or indexes."""
    try:
        meta = spark.read.parquet(f"{folder.rstrip('/')}/v-*/meta").select("saved", F.col("_metadata.file_path").alias("file"))
    except AnalysisException:
        return None
    last = meta.orderBy(F.desc("saved"), "file").first()
    return last["file"].rsplit("/meta/", 1)[0] if last else None


def load(spark: SparkSession, path: str) -> Snapshot:
    """A stored snapshot; one of another version is an error."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["schema_version"] != SNAPSHOT_VERSION:
        raise ValueError(f"snapshot {path} has version {meta['schema_version']}, expected {SNAPSHOT_VERSION}: scan again")
    tables = {n: spark.read.schema(kind).parquet(f"{path}/{n}") for n, kind in TABLES.items()}
    return Snapshot(**tables, root=meta["root"], schema_version=meta["schema_version"], parser=meta["parser"], path=path)


def find(snapshot: Snapshot, pattern: str) -> DataFrame:
    """Symbols that contain a pattern; by the stored index where there is one."""
    index = trigrams.load(snapshot.files.sparkSession, snapshot.path) if snapshot.path else None
    return lookup.find(snapshot.symbols, pattern) if index is None else trigrams.find(index, pattern).rows


def normalised(symbols: DataFrame) -> DataFrame:
    """Rows with null fields as empty and malformed lines as 0."""
    return symbols.select(*(text(c).alias(c) for c in ("section", "name", "file")), number("line").alias("line"), *(text(c).alias(c) for c in ("signature", "docstring", "language")), "ord")
