import random

import pytest
from pyspark.sql import functions as F

from symbolake.plans.ranking import digits, joined, ranked


@pytest.mark.parametrize("parts", [1, 3, 64, None])
def test_positions_are_those_of_a_sort(spark, parts):
    rnd = random.Random(parts or 0)
    words = ["".join(rnd.choice("aB-é_/\U0001f600") for _ in range(rnd.randint(0, 6))) for _ in range(500)]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)] + [(None, 999)], "w string, i int").repartition(5)
    got = ranked(df, F.col("w"), parts=parts).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [*range(501)]
    assert [r.w for r in got] == [None, *sorted(words, key=str.encode)]
    assert got[0].i == 999 and sorted(got[0].asDict()) == ["i", "rank", "w"]


def test_keys_of_several_columns(spark):
    rows = [("a", "b", 2), ("a", "b", 10), ("a", None, 1), ("ab", "", 1), ("a\x01", "", 1)]
    df = spark.createDataFrame(rows, "x string, y string, n long").withColumn("d", digits("n"))
    got = ranked(df, joined("x", "y", "d"), "place").orderBy("place").select("x", "y", "n").collect()
    assert [tuple(r) for r in got] == [("a", None, 1), ("a", "b", 2), ("a", "b", 10), ("a\x01", "", 1), ("ab", "", 1)]
    assert ranked(df.where("false"), F.col("x")).count() == 0


def test_a_heavy_key_fills_several_ranges(spark):
    """Half of the rows share one key and a third have none; no range has much more than its share."""
    df = spark.range(6000).select(F.when(F.col("id") % 6 < 3, "same").when(F.col("id") % 6 < 5, F.lit(None).cast("string")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = ranked(df, F.col("k"), parts=12)
    sizes = [r[0] for r in got.select(F.input_file_name().alias("f")).groupBy("f").count().select("count").collect()]
    assert len(sizes) >= 9 and max(sizes) <= 3 * 6000 / 12
    ranks = [(r["rank"], r.k) for r in got.orderBy("rank").collect()]
    assert [r for r, _ in ranks] == [*range(6000)] and [k for _, k in ranks] == sorted((k for _, k in ranks), key=lambda k: (k is not None, (k or "").encode()))
