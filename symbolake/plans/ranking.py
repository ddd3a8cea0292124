"""Global positions of rows in an order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolake.plans.workspace import written

#: Bits of monotonically_increasing_id that number the rows of one partition.
_WITHIN = (1 << 33) - 1


def ranked(rows: DataFrame, key: Column, name: str = "rank", parts: int | None = None) -> DataFrame:
    """Add the position (from 0) of each row by a string key, null first; rows of equal keys in any order.

    Spark deals the rows to ranges that it samples from all of them, so that a range
    has as many rows as others, whatever its keys weigh; rows of one heavy key are
    told apart by a hash of the row and may fill several ranges. The number of
    ranges is the session's number of shuffle partitions, or fewer as adaptive
    execution joins small ones, unless ``parts`` gives it. Sorted ranges are written
    once, and each starts after the rows of those before it.
    """
    plain = [F.col(f"`{f.name}`") for f in rows.schema.fields if isinstance(f.dataType, T.AtomicType)]
    keyed = rows.withColumn("key_", key).withColumn("tie_", F.xxhash64(*plain) if plain else F.lit(0))
    order = ("key_", "tie_")
    dealt = keyed.repartitionByRange(parts, *order) if parts else keyed.repartitionByRange(*order)
    numbered = dealt.sortWithinPartitions(*order).select(*rows.columns, F.spark_partition_id().alias("range_"), F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN)).alias("at_"))
    held = written(numbered, "ranked")
    sizes = sorted(held.groupBy("range_").count().collect())  # one row a range
    starts, total = [], 0
    for part, size in sizes:
        starts.append((part, total))
        total += size
    before = rows.sparkSession.createDataFrame(starts, "range_ int, before_ long")
    placed = held.join(F.broadcast(before), "range_")
    return placed.select(*rows.columns, (F.col("before_") + F.col("at_")).alias(name))


def joined(*columns: str) -> Column:
    """A key that orders by strings one after another, nulls as empty."""
    return F.concat_ws("\0", *(F.coalesce(F.col(c), F.lit("")) for c in columns))


def digits(column: str, width: int = 19) -> Column:
    """A key of non-negative integers."""
    return F.lpad(F.col(column).cast("string"), width, "0")
