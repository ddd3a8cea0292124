"""Differences between two snapshots: full outer joins on files and on symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symbolake.functions import identity, number, text

# Names of the kinds of changes.
KINDS = ("files_added", "files_removed", "files_changed", "symbols_added", "symbols_removed", "symbols_moved", "symbols_signature_changed")


def diff_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, sha256) twice -> kind, file."""
    a = old.select("file", F.col("sha256").alias("before"))
    b = new.select("file", F.col("sha256").alias("after"))
    kind = F.when(F.col("before").isNull(), "files_added").when(F.col("after").isNull(), "files_removed").when(F.col("before") != F.col("after"), "files_changed")
    return a.join(b, "file", "full_outer").select(kind.alias("kind"), "file").where("kind is not null")


def numbered(symbols: DataFrame) -> DataFrame:
    """Symbols with their place, by line, among those of equal section, name and file."""
    rows = symbols.select(
        text("section").alias("section"), text("name").alias("name"), text("file").alias("file"), number("line").alias("line"),
        text("signature").alias("signature"), "ord" if "ord" in symbols.columns else F.lit(0).alias("ord"),
    )
    nth = F.row_number().over(Window.partitionBy("section", "name", "file").orderBy("line", "ord"))
    return rows.withColumn("nth", nth).drop("ord")


def diff_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """kind, key, section, name, file, line, signature, old_line, new_line, old_signature, new_signature.

    A symbol that moved and was given another signature has a row for each.
    """
    on = ["section", "name", "file", "nth"]
    a = numbered(old).withColumnsRenamed({"line": "old_line", "signature": "old_signature"})
    b = numbered(new).withColumnsRenamed({"line": "new_line", "signature": "new_signature"})
    both = a.join(b, on, "full_outer")
    gone, come = F.col("new_line").isNull(), F.col("old_line").isNull()
    kinds = F.array_compact(F.array(
        F.when(come, "symbols_added"),
        F.when(gone, "symbols_removed"),
        F.when(F.col("old_line") != F.col("new_line"), "symbols_moved"),
        F.when(F.col("old_signature") != F.col("new_signature"), "symbols_signature_changed"),
    ))
    line, signature = F.coalesce("new_line", "old_line"), F.coalesce("new_signature", "old_signature")
    return both.select(F.explode(kinds).alias("kind"), identity().alias("key"), "section", "name", "file", line.alias("line"), signature.alias("signature"), "old_line", "new_line", "old_signature", "new_signature")


def summary(*changes: DataFrame) -> DataFrame:
    """One row: the count of every kind, zeros included, and total_changes."""
    kinds = changes[0].select("kind")
    for c in changes[1:]:
        kinds = kinds.unionByName(c.select("kind"))
    return kinds.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS), F.count("*").alias("total_changes"))
