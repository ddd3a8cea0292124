"""Mixing sources to target weights by hash-threshold histograms, without a sort.

Sources in code point order (null last) weigh 1, 2, 3, 1, ...; targets share
the words of all documents by weight, stop at REPEATS times their source's
words, and the excess is shared again until none is above. A source whose target
is ``r`` times its words is taken whole floor(r) times; the rest of the budget
goes to the documents whose hash lies under a threshold.

The threshold is found digit by digit. Words are summed by (source, first digit
of the hash), the digit in which the budget runs out is found from these sums,
and only the documents in that bucket are summed by their next digit, until all
digits are fixed. Budgets are nested: a larger budget takes the same documents
and more. The last bucket holds equal rows, which no hash tells apart: as many of
them are taken as come nearest to the budget. They are counted in parts of a task
each, so that a document repeated without end is no single task's or row's.

Edge cases: null, empty and blank texts have size 0 and are taken 0 times. A
null source is a source. Documents with equal doc_id and text share a hash, and
those that differ in other columns stand in the order of a hash of these. A source without words has target 0. An empty table gives no
rows. A very long text is only counted and hashed, whole. Other columns are ignored
by ``mix_table`` and kept by ``mix_documents``, whatever their names, which repeats rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolake.llm.base import fits, n_words, stash

REPEATS = 3
#: Hash digits of 15 bits, four of them.
DIGIT, DIGITS = 15, 4
WEIGHTS = (1, 2, 3)
#: Parts of a hot source where sources are too many to be broadcast.
SALTS = 32


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of a digest of the document."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) -> also id, target: weights shared with caps.

    The target is min(level * weight, REPEATS * source_size) for the one level
    at which targets add up; it is read off the sources in the order in which
    they reach their caps.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("id") % len(WEIGHTS) + 1).cast("int"))
    named = sources.withColumn("id", F.row_number().over(order) - 1).withColumn("weight", weight)
    full = named.withColumn("cap", REPEATS * F.col("source_size")).withColumn("reach", F.col("cap") / F.col("weight"))
    total, weights = full.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    up = Window.orderBy("reach", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # sources up to the i-th are capped: what is left to the others gives a level, valid while it reaches no further cap
    rest = F.lit(weights) - F.sum("weight").over(up)
    level = F.when(rest > 0, (F.lit(total) - F.sum("cap").over(up)) / rest)
    found = full.select("reach", level.alias("level")).where("level >= reach").agg(F.max("level")).first()[0]
    top = max(total / weights, found or 0.0)  # the level only rises as caps bind
    return full.select("source", "source_size", "id", F.least(F.lit(top) * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def _with_source(light: DataFrame, side: DataFrame, few: bool) -> DataFrame:
    """Join rows to their source's row; a hot source is spread over salts where sources are many."""
    side = side.withColumnRenamed("source", "source_")
    if few:
        return light.join(F.broadcast(side), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    salted = side.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = F.col("source").eqNullSafe(F.col("source_")) & ((F.col("u") % SALTS).cast("int") == F.col("salt_"))
    return light.join(salted, hit).drop("source_", "salt_")


def thresholds(light: DataFrame) -> DataFrame:
    """source, source_size, target, whole (times all are taken), cut, at_cut (equal to the cut is taken)."""
    sources = stash(targets(stash(light.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")), "sources")
    few = fits(sources)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = sources.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    for k in range(DIGITS):
        shift = DIGIT * (DIGITS - 1 - k)
        inside = _with_source(light.where("size > 0"), state.where("left > 0").select("source", "prefix", "left"), few)
        inside = inside.where(F.shiftright("u", shift + DIGIT) == F.col("prefix"))
        sums = inside.groupBy("source", "prefix", "left", (F.shiftright("u", shift) % 2**DIGIT).alias("digit")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        over = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("reached", F.sum("words").over(over))
        edge = sums.where(F.col("reached") >= F.col("left")).groupBy("source").agg(F.min_by(F.struct("digit", "words", "rows", "reached"), "digit").alias("e"))
        edge = edge.select(F.col("source").alias("s_"), "e")
        state = state.join(F.broadcast(edge) if few else edge, F.col("source").eqNullSafe(F.col("s_")), "left")
        # a source without a boundary has nothing left to take, or takes all but rounding
        state = state.select(
            "source", "source_size", "target", "whole",
            F.when(F.col("e").isNotNull(), F.col("left") - (F.col("e.reached") - F.col("e.words"))).otherwise(F.col("left")).alias("left"),
            F.when(F.col("e").isNotNull(), F.col("prefix") * 2**DIGIT + F.col("e.digit")).otherwise(F.when(F.col("left") > 0, F.lit(2 ** (DIGIT * (k + 1)))).otherwise(F.lit(0))).alias("prefix"),
            F.col("e.words").alias("words"), F.col("e.rows").alias("rows"),
        )
        state = stash(state if k == DIGITS - 1 else state.drop("words", "rows"), "boundary")
    # rows at the cut are equal; so many of them come nearest to what is left
    nearest = F.least(F.floor(F.col("left") * F.col("rows") / F.col("words") + 0.5), F.col("rows"))
    return state.select("source", "source_size", "target", "whole", F.col("prefix").alias("cut"), F.coalesce(nearest, F.lit(0)).cast("long").alias("n_cut"), F.coalesce("rows", F.lit(0)).alias("at_cut"))


def _times(rows: DataFrame, cuts: DataFrame, few: bool) -> DataFrame:
    """``rows`` (source, u, size and others) with the columns of their source's cut and times, how often each is taken."""
    joined = _with_source(rows, cuts, few)
    at = (F.col("u") == F.col("cut")) & (F.col("size") > 0)
    split = at & (F.col("n_cut") > 0) & (F.col("n_cut") < F.col("at_cut"))
    more = (F.col("u") < F.col("cut")) | (at & (F.col("n_cut") > 0))
    plain = F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(0)
    if not cuts.where("n_cut > 0 and n_cut < at_cut").limit(1).count():
        return joined.withColumn("times", plain)
    # equal rows of a task are one row with their number; parts of a source follow each other
    names = joined.columns
    parts = joined.where(split).groupBy(*names, F.spark_partition_id().alias("part_")).agg(F.count(F.lit(1)).alias("n_"))
    up = Window.partitionBy("source").orderBy(F.xxhash64(*names), "part_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("before_", F.sum("n_").over(up) - F.col("n_"))
    tied = parts.select(*names, "before_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_"))).alias("k_"))
    tied = tied.select(*names, (F.col("whole") + (F.col("before_") + F.col("k_") <= F.col("n_cut")).cast("long")).alias("times"))
    return joined.where(~split).withColumn("times", plain).unionByName(tied)


def mix_table(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every row."""
    light = stash(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("u")), "words")
    cuts = thresholds(light)
    taken = _times(light, cuts, fits(cuts))
    return taken.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Every document as many times as the mix takes it, with all of its columns."""
    light = stash(docs.select("source", n_words(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("u")), "words")
    cuts = thresholds(light)
    # the document travels as one column, so that none of its names clashes
    rows = docs.select(F.struct("*").alias("doc"), "source", hash_of(F.col("doc_id"), F.col("text")).alias("u"), n_words(F.col("text")).alias("size"))
    joined = _times(rows, cuts.select("source", "whole", "cut", "n_cut", "at_cut"), fits(cuts))
    return joined.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("doc.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS id FROM d GROUP BY source),
w AS (SELECT *, id % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT coalesce(max(level), 0) AS level FROM (
  SELECT ((SELECT sum(source_size) FROM w) - coalesce((SELECT sum(cap) FROM w b WHERE b.cap / b.weight <= a.cap / a.weight), 0))
         / nullif((SELECT sum(weight) FROM w b WHERE b.cap / b.weight > a.cap / a.weight), 0) AS level, a.cap / a.weight AS reach FROM w a
  UNION ALL SELECT sum(source_size) / sum(weight), -1 FROM w) WHERE level >= reach),
t AS (SELECT source, source_size, least(level * weight, cap::DOUBLE) AS target FROM w, l),
t2 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
g AS (SELECT source, u, sum(size) AS words, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL),
c AS (SELECT source, u, words, n, sum(words) OVER (PARTITION BY source ORDER BY u) AS reached FROM g),
k AS (SELECT c.source, c.u, CASE WHEN reached < left_ THEN n WHEN reached - words < left_ THEN least(n, floor((left_ - (reached - words)) * n / words + 0.5)) ELSE 0 END AS more
      FROM c JOIN (SELECT *, target - whole * source_size AS left_ FROM t2) x ON c.source IS NOT DISTINCT FROM x.source),
e AS (SELECT *, row_number() OVER (PARTITION BY source, u) AS nth FROM d)
SELECT d.doc_id, d.source, d.size, t2.source_size, t2.target,
       CASE WHEN d.size > 0 THEN d.size * (t2.whole + (d.nth <= k.more)::BIGINT) ELSE 0 END::BIGINT AS taken
FROM e d JOIN t2 ON d.source IS NOT DISTINCT FROM t2.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.u = k.u
"""
