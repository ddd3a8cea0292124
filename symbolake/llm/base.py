"""Shared plumbing: the shared work folder, bounded broadcasts, small helpers."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as the word contracts of this package define it.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of a lookup side that may be broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session on one machine may go without the setting; it then gets a
    temporary folder that is removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="symbolake-work-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str, codec: str = "snappy", few: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage: what follows survives the loss of executors without running
    what came before again. Light tables may be written as ``few`` files, two for
    each core, however many partitions they come in.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    if few:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*stashes: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for df in stashes:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files and broadcasts of finished steps that nothing refers to.

    Spark frees those only when the driver's memory is collected, which a series
    of many small jobs may not bring about for long.
    """
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 512, size: str = "8m") -> None:
    """Hold the Arrow batches that go to Python to ``rows`` rows and ``size`` bytes (or one row), as texts may be long.

    These are settings of the session; results do not depend on them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fits(small: DataFrame) -> bool:
    """Whether a written side may be broadcast: its measured bytes, with 16 for each row, are within BROADCAST_BYTES."""
    strings = [F.octet_length(f.name) for f in small.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    fixed = 16 + sum(8 * len(f.dataType.fields) if isinstance(f.dataType, T.StructType) else 8 for f in small.schema.fields)
    rows, size = small.agg(F.count(F.lit(1)), sum((F.coalesce(F.sum(x), F.lit(0)) for x in strings), F.lit(0))).first()
    return rows * fixed + size <= BROADCAST_BYTES


def lookup(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join a large side to a written lookup side.

    Broadcast where it ``fits``; beyond, a sort-merge join, whose skewed
    partitions adaptive execution splits.
    """
    if fits(small):
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that it is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bare(text: Column) -> Column:
    """The text without ASCII white space at its ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = bare(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE, -1))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
