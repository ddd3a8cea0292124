"""Look up symbols and call edges: filters and one anti join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolake.functions import haystack, last_segment
from symbolake.model import EDGE_LANGUAGE


def find(symbols: DataFrame, pattern: str) -> DataFrame:
    """Symbols whose name, signature, docstring or file (joined by spaces) contains the pattern, in any case."""
    return symbols.where(F.contains(haystack(), F.lit(pattern.lower())))


def section(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("section") == name)


def callers_of(calls: DataFrame, name: str) -> DataFrame:
    """Edges into the last segment of a name."""
    return calls.where(F.col("callee") == name.rsplit(".", 1)[-1])


def callees_of(calls: DataFrame, name: str) -> DataFrame:
    """Edges out of a name, or out of any caller with the same last segment."""
    return calls.where((F.col("caller") == name) | (last_segment(F.col("caller")) == name.rsplit(".", 1)[-1]))


def unused(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Python symbols that no call names, without dunders, tests and ``main``: a hint, not a verdict."""
    bare = last_segment(F.col("name"))
    dunder = bare.startswith("__") & bare.endswith("__")
    kept = symbols.where((F.col("language") == EDGE_LANGUAGE) & ~dunder & ~bare.startswith("test_") & (bare != "main"))
    return kept.withColumn("bare_", bare).join(calls.select(F.col("callee").alias("bare_")).distinct(), "bare_", "left_anti").drop("bare_")


def totals(files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame) -> dict[str, int]:
    """Counts of a scan report."""
    return {"files": files.count(), "symbols": symbols.count(), "files_with_imports": imports.select("file").distinct().count(), "calls": calls.count()}
