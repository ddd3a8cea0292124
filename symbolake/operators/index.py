"""State of the vector index: pending, prune, rekey, upsert, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolake.functions import entry_hash, entry_key, entry_text, number, stripped, text


def entries_of(symbols: DataFrame, model: str = "", dim: int = 0) -> DataFrame:
    """Index rows of symbols: the columns, key, text and hash; the last of equal keys stays."""
    rows = symbols.select(
        text("section").alias("section"), text("name").alias("name"), text("file").alias("file"), number("line").alias("line"),
        text("signature").alias("signature"), stripped(text("docstring")).alias("docstring"), "ord",
    )
    keyed = rows.withColumn("key", entry_key()).withColumn("text", entry_text()).withColumn("hash", entry_hash(model, dim))
    return last_of_key(keyed)


def last_of_key(rows: DataFrame) -> DataFrame:
    """Of rows with equal key the one with the largest ``ord``, in the place of the first."""
    # aggregated before the shuffle, so that a key with very many rows is no single task's
    one = rows.groupBy("key").agg(F.max_by(F.struct(*rows.columns), "ord").alias("row"), F.min("ord").alias("first_"))
    return one.select(*(F.col("first_").alias(c) if c == "ord" else F.col(f"row.{c}") for c in rows.columns))


def pending(entries: DataFrame, index: DataFrame, same_model: bool = True) -> DataFrame:
    """Entries that the index lacks or holds with another hash; all of them for another model."""
    if not same_model:
        return entries
    held = index.select("key", F.col("hash").alias("held_"))
    return entries.join(held, "key", "left").where(~F.col("hash").eqNullSafe(F.col("held_"))).drop("held_")


def prune(index: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index rows that still have an entry, and those that have none."""
    keys = entries.select("key").distinct()
    return index.join(keys, "key", "left_semi"), index.join(keys, "key", "left_anti")


def rekey(index: DataFrame) -> DataFrame:
    """Keys made again from the rows' own columns."""
    return last_of_key(index.withColumn("key", entry_key()))


def upsert(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """Index with fresh rows: a known key keeps its place, new keys follow in their order."""
    top = index.agg(F.max("ord")).first()[0]
    start = -1 if top is None else top
    old = index.select("key", F.col("ord").alias("held_"))
    placed = fresh.join(old, "key", "left")
    placed = placed.withColumn("ord", F.coalesce("held_", F.lit(start + 1) + F.col("ord"))).drop("held_")
    return index.join(fresh.select("key"), "key", "left_anti").unionByName(placed.select(index.columns))


def status(entries: DataFrame, index: DataFrame) -> DataFrame:
    """One row: resources of the snapshot, of the index, and entries that are stale."""
    held = index.select("key", F.col("hash").alias("held"), F.lit(1).alias("in_index"))
    both = entries.select("key", "hash", F.lit(1).alias("in_snapshot")).join(held, "key", "full_outer")
    stale = F.col("in_snapshot").isNotNull() & ~F.col("hash").eqNullSafe(F.col("held"))
    return both.agg(F.count("in_snapshot").alias("resources"), F.count("in_index").alias("indexed"), F.count_if(stale).alias("stale"))
