"""Structured Streaming: keep symbol tables fresh from a stream of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symbolake.operators import extract

#: What a change stream carries: one row a saved version of a file.
CHANGES = "ord long, file string, ext string, content binary, ts timestamp"


def latest(changes: DataFrame) -> DataFrame:
    """The newest version of each file within a batch."""
    newest = changes.groupBy("file").agg(F.max_by(F.struct(*changes.columns), F.struct("ts", "ord")).alias("row"))
    return newest.select("row.*")


def refresh_symbols(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the symbols of every changed file, with batch and hash, to a Parquet table.

    A batch that runs again overwrites its own folder, so each version counts once.
    """

    def each(batch: DataFrame, number: int) -> None:
        files = latest(batch).withColumn("sha256", F.sha2("content", 256))
        symbols = extract.symbols_of(extract.python_table(files)).unionByName(extract.line_symbols(files))
        out = files.select("file", "sha256", "ts").join(symbols, "file", "left").withColumn("batch", F.lit(number))
        out.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(versions: DataFrame) -> DataFrame:
    """The symbols of each file's newest version in a table that ``refresh_symbols`` fills."""
    newest = versions.groupBy("file").agg(F.max_by("batch", "ts").alias("batch"))
    return versions.join(newest, ["file", "batch"], "left_semi").where("name is not null")


def change_counts(changes: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Changed files by event-time window, with late rows up to the watermark."""
    return changes.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.approx_count_distinct("file").alias("files"), F.count("*").alias("versions"))
