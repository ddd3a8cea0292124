"""Life cycle of the vector index, kept as a JSON document or as a store of Parquet versions."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from symbolake.model import EMBED_BATCH, ENTRIES, KEY_VERSION, SEARCH_K, TIMEOUT_S, TOP_K
from symbolake.operators import clusters, vectors
from symbolake.operators import index as ops
from symbolake.providers import Request, embed_table

FIELDS = ("section", "name", "file", "line", "signature", "docstring", "hash", "vector")


@dataclass
class Index:
    rows: DataFrame
    model: str = ""
    dim: int = 0
    key_schema: int = KEY_VERSION
    centroid: list[float] = field(default_factory=list)
    #: Where the rows are stored, if they are.
    path: str = ""


def from_document(spark: SparkSession, document: dict) -> Index:
    rows = []
    for i, (key, e) in enumerate((document.get("entries") or {}).items()):
        vector = [float(x) for x in e.get("vector") or []]
        rows.append((key, e.get("section") or "", e.get("name") or "", e.get("file") or "", int(e.get("line") or 0), e.get("signature") or "", e.get("docstring") or "", e.get("hash") or "", vector, i))
    return Index(spark.createDataFrame(rows, ENTRIES), document.get("model") or "", int(document.get("dim") or 0), int(document.get("key_schema") or 1), document.get("centroid") or [])


def to_document(index: Index) -> dict:
    entries = {r["key"]: {f: r[f] if f != "vector" else [*r[f]] for f in FIELDS} for r in index.rows.orderBy("ord").toLocalIterator()}
    return {"model": index.model, "dim": index.dim, "key_schema": KEY_VERSION, "centroid": index.centroid, "entries": entries}


META = "model string, dim int, key_schema int, centroid array<double>"


def save(index: Index, folder: str) -> str:
    """Store the rows as Parquet under a new version of ``folder``, by clusters where they have vectors; returns the version's path."""
    spark, path = index.rows.sparkSession, f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    if index.centroid:
        clusters.build(index.rows, index.centroid, path)
    else:
        index.rows.write.parquet(f"{path}/entries")
    meta = spark.createDataFrame([(index.model, index.dim, KEY_VERSION, index.centroid)], META)
    meta.withColumn("saved", F.current_timestamp()).coalesce(1).write.parquet(f"{path}/meta")
    return path


def load(spark: SparkSession, path: str) -> Index:
    """A stored index; its rows are read from Parquet where a plan needs them."""
    meta = spark.read.parquet(f"{path}/meta").first()
    rows = spark.read.schema(ENTRIES).parquet(f"{path}/entries").select(*clusters.NAMES)
    return Index(rows, meta["model"], meta["dim"], meta["key_schema"], [*meta["centroid"]], path)


def search(index: Index, query: list[float], k: float = SEARCH_K, top: int = TOP_K, section: str | None = None) -> DataFrame:
    """The best entries above the gate; of a stored index only the clusters that can hold them are read."""
    stored = clusters.load(index.rows.sparkSession, index.path) if index.path else None
    if stored is None:
        return vectors.search(index.rows, query, index.centroid, k, top, section)
    return clusters.search(stored, query, k, top, section).rows


@dataclass
class Refreshed:
    index: Index
    total: int
    pruned: int
    migrated: int
    embedded: int
    discarded: int
    error: Exception | None = None
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Let go of what is kept in storage while the index is written."""
        while self.held:
            self.held.pop().unpersist()


def refresh(symbols: DataFrame, old: Index, embed: Callable[[Request], list[list[float]]], model: str, dim: int, batch: int = EMBED_BATCH, timeout: float = TIMEOUT_S, progress: Callable[[int, int], None] | None = None, on_executors=None) -> Refreshed:
    """Bring an index up to date with symbols.

    Another model or size starts a new index. Old keys are made again from the
    rows, rows without a symbol are pruned, and what is new or has another hash
    is embedded batch by batch. A provider error ends embedding; what was done by
    then is kept, and the error is returned with it. A provider without keys may be
    given as ``on_executors``; then no vector passes through the driver.
    """
    spark = symbols.sparkSession
    entries = ops.entries_of(symbols, model, dim).persist()
    rows, discarded, migrated = old.rows, 0, 0
    if (old.model, old.dim) != (model, dim):
        discarded = rows.count()
        rows = spark.createDataFrame([], ENTRIES)
    elif old.key_schema != KEY_VERSION:
        rows = ops.rekey(rows)
        migrated = rows.count()
    kept, gone = ops.prune(rows, entries)
    pruned = gone.count()
    todo = ops.pending(entries, kept).orderBy("ord")
    n = todo.count()
    fresh, waiting, error, done = [], [], None, 0

    def send() -> None:
        nonlocal done
        got = embed(Request(tuple(r["text"] for r in waiting), "document", model, dim, timeout))
        fresh.extend((r["key"], r["section"], r["name"], r["file"], r["line"], r["signature"], r["docstring"], r["hash"], [*v], r["ord"]) for r, v in zip(waiting, got, strict=True))
        done += len(waiting)
        waiting.clear()
        if progress:
            progress(done, n)

    held = [entries]
    if on_executors is not None:
        made = embed_table(todo, on_executors, model, dim, batch).persist(StorageLevel.DISK_ONLY)
        held.append(made)
        new, done = todo.join(made, "key").select(kept.columns), n
    else:
        try:
            for r in todo.toLocalIterator():
                waiting.append(r)
                if len(waiting) == batch:
                    send()
            if waiting:
                send()
        except RuntimeError as e:
            error = e
        new = spark.createDataFrame(fresh, ENTRIES)
    rows = ops.upsert(kept, new) if done else kept
    # a centroid belongs to its version of the index: it is computed once, over rows in their order
    some = rows.where(F.size("vector") > 0)
    index = Index(rows, model, dim, KEY_VERSION, vectors.centroid(some))
    return Refreshed(index, symbols.count(), pruned, migrated, done, discarded, error, held)


def stale(symbols: DataFrame, index: Index) -> dict[str, int]:
    entries = ops.entries_of(symbols, index.model, index.dim)
    return ops.status(entries, index.rows).first().asDict()

