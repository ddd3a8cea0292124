import random

import pytest
from pyspark.sql import functions as F

from symbolake.model import SYMBOLS
from symbolake.operators import lookup, trigrams


@pytest.fixture(scope="module")
def symbols(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé\U0001f600 _") for _ in range(rnd.randrange(9)))
    rows = [("s", word(), f"f{i % 40}", i, word(), rnd.choice([None, word()]), "x", i) for i in range(300)]
    return spark.createDataFrame([*rows, (None, None, None, None, None, None, None, 999), ("s", "İx ǅ ΣΑΣ", "hot", 1, "", "", "", 1000)], SYMBOLS).persist()


def test_same_rows_as_a_scan(spark, symbols, tmp_path):
    trigrams.build(symbols, str(tmp_path / "i"), rows=10)
    index = trigrams.load(spark, str(tmp_path / "i"))
    assert index.parts > 15 and index.symbols.count() == symbols.count()
    least = index.parts
    for pattern in ("", "a", "ab", "abc", "AbC", "a b", "é\U0001f600", "\U0001f600ab", "e f1", "f39", "zzz", "İX", "σας", " "):
        got = trigrams.find(index, pattern)
        assert sorted(r.ord for r in got.rows.collect()) == sorted(r.ord for r in lookup.find(symbols, pattern).collect()), pattern
        least = min(least, got.parts_read)
    assert least == 0
    rare = trigrams.find(index, "e f39")
    assert rare.parts_read < rare.parts
    assert "PartitionFilters: []" not in rare.rows._jdf.queryExecution().executedPlan().toString()


def test_parts_keep_their_size_beyond_the_folders(spark, symbols, tmp_path, monkeypatch):
    """More parts than folders: a rare pattern still leaves most parts unread, and all rows are found, named or joined."""
    for name in ("PARTS", "FOLDERS"):
        monkeypatch.setattr(trigrams, name, 3, raising=False)
    many = spark.range(4000).selectExpr("'s' section", "'n' name", "concat('doc', id) file", "1 line", "'' signature", "'' docstring", "'' language", "id ord")
    trigrams.build(many, str(tmp_path / "m"), rows=8)
    index = trigrams.load(spark, str(tmp_path / "m"))
    assert index.symbols.count() == 4000
    for named in (4096, 1):
        monkeypatch.setattr(trigrams, "NAMED", named, raising=False)
        for pattern in ("DOC177", "doc", "39 ", "zzz"):
            got = trigrams.find(index, pattern)
            assert sorted(r.ord for r in got.rows.collect()) == sorted(r.ord for r in lookup.find(many, pattern).collect())
        assert 0 < 2 * trigrams.find(index, "DOC177").parts_read < index.parts


def test_grams_of_odd_texts(spark):
    df = spark.createDataFrame([("",), ("ab",), ("abc",), ("abcabc",), (None,)], "t string")
    assert [None if r[0] is None else len(r[0]) for r in df.select(trigrams.grams(F.col("t"))).collect()] == [0, 0, 1, 3, None]
    long = spark.range(1).select(trigrams.grams(F.repeat(F.lit("abcdefghij"), 40_000)).alias("g"))
    assert long.select(F.size("g")).first()[0] == 10


def test_empty_index(spark, symbols, tmp_path):
    trigrams.build(symbols.limit(0), str(tmp_path / "e"))
    index = trigrams.load(spark, str(tmp_path / "e"))
    assert index is None or trigrams.find(index, "abc").rows.count() == 0
    assert trigrams.load(spark, str(tmp_path / "none")) is None
