"""Substring search with an index of trigrams: only parts that can hold the pattern are read.

Symbols are written in parts by the hash of their file, in folders of Parquet files
sorted by part, and beside them which trigrams (as hashes of three characters of the
searched text) occur in which part, in buckets by trigram. A search looks its pattern's
trigrams up in their buckets alone, reads the parts that have all of them, and
compares those rows as ``lookup.find`` does; so hash collisions and trigrams that
stand apart cost reading and never a row. Patterns under three characters read all.

Parts keep their size however large the table is, so that a rare pattern stays rare
among them; there are at most FOLDERS folders, and parts beyond share them. A hot file
makes one part large, whose folder then has several files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolake.functions import haystack
from symbolake.model import SYMBOLS
from symbolake.operators import lookup

#: Rows that a part is meant to have, most folders of parts, and buckets of trigrams.
ROWS, FOLDERS, BUCKETS = 4096, 4096, 64
#: Wanted parts that are named in the scan's filter; more are joined.
NAMED = 4096
NAMES = [f.split()[0] for f in SYMBOLS.split(", ")]
STORED = f"{SYMBOLS}, part long, folder int"


def grams(text: Column) -> Column:
    """Hashes of the distinct trigrams of a text, in linear time."""
    chars = F.split(text, "", -1)
    three = lambda c: F.transform(F.slice(c, 1, F.greatest(F.size(c) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(c, i + 1), F.get(c, i + 2)))
    return F.array_distinct(F.element_at(F.transform(F.array(chars), three), 1))


@dataclass
class FindIndex:
    symbols: DataFrame
    postings: DataFrame
    parts: int


@dataclass
class Found:
    rows: DataFrame
    parts_read: int
    parts: int


def build(symbols: DataFrame, path: str, rows: int = ROWS) -> None:
    """Write symbols and their index under ``path``."""
    parts = max(1, -(-symbols.count() // rows))
    placed = symbols.select(*NAMES, F.pmod(F.xxhash64(F.coalesce("file", F.lit(""))), F.lit(parts)).alias("part"))
    placed = placed.withColumn("folder", F.pmod("part", F.lit(FOLDERS)).cast("int"))
    placed.hint("rebalance", "folder").sortWithinPartitions("folder", "part").write.partitionBy("folder").parquet(f"{path}/by_folder")
    held = symbols.sparkSession.read.schema(STORED).parquet(f"{path}/by_folder")
    each = held.select("part", F.explode(grams(haystack())).alias("gram")).distinct()
    bucketed = each.withColumn("bucket", F.pmod("gram", F.lit(BUCKETS)).cast("int"))
    bucketed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/grams")


def load(spark: SparkSession, path: str) -> FindIndex | None:
    """The index under a path, or None where there is none."""
    try:
        postings = spark.read.parquet(f"{path}/grams")
        symbols = spark.read.schema(STORED).parquet(f"{path}/by_folder")
    except AnalysisException:
        return None
    return FindIndex(symbols, postings, symbols.select("part").distinct().count())


def find(index: FindIndex, pattern: str) -> Found:
    """The rows of ``lookup.find`` over all symbols, from the parts that have the pattern's trigrams."""
    rows, read = index.symbols, index.parts
    if len(pattern.lower()) >= 3:
        wanted = index.symbols.sparkSession.range(1).select(grams(F.lit(pattern.lower()))).first()[0]
        near = index.postings.where(F.col("bucket").isin(sorted({g % BUCKETS for g in wanted})) & F.col("gram").isin(wanted))
        held = near.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("part")
        read = held.count()
        folders = [r[0] for r in held.select(F.pmod("part", F.lit(FOLDERS)).cast("int")).distinct().collect()]  # at most FOLDERS
        rows = rows.where(F.col("folder").isin(sorted(folders)))
        if read <= NAMED:
            rows = rows.where(F.col("part").isin(sorted(r[0] for r in held.collect())))
        else:
            rows = rows.join(held, "part", "left_semi")
    return Found(lookup.find(rows, pattern).select(*NAMES), read, index.parts)
