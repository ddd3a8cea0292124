"""Quality rules with thresholds from mergeable quantile sketches per language and source.

Each document gets whole-text measures (all of them built-in functions). Their
distribution within a language and source is kept as a sketch: counts of values
rounded to six significant bits, so at most a few hundred counters whatever the
group, exact in rank, within 3 % in value, and mergeable by adding counters. A
language's sketch is the sum of its groups' sketches, and that of all documents
the sum of all. Quartiles are read from the sketches and shrunk to those of the
next larger sketch as if that had PRIOR documents more of its kind in the group:
(docs * own + PRIOR * larger) // (docs + PRIOR). So a group of a few documents is
judged nearly as its language is, a large one by itself, and no count is a cliff.
A group's fences are its quartiles widened by SPREAD times their distance, and at
least by the measure's least spread. Documents are then joined to their group's
fences and kept when they lie within all of them.

Edge cases: null, empty and blank texts have no words and fail the base rule.
Null languages and sources are groups of their own. Rows with equal doc_id are
judged one by one. Very long texts are arrays of their words, about 50 bytes a
word. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolake.llm.base import SPACE, bare, fits, let, stash, words

MIN_WORDS, MAX_REPEATED = 50, 50
#: Documents that the larger sketch counts for within a group.
PRIOR = 100
SPREAD = 3
#: Measures in thousandths, the least spread of each, and whether it has a lower fence.
MEASURES = (("symbols", 100, False), ("dup_lines", 200, False), ("repeats", 250, False), ("word_len", 1500, True))


def repeated_words(w: Column) -> Column:
    """Words of an array column that lie in a three-word window found twice or more.

    Windows are hashed; texts whose hashes are all distinct end there. Else hashes
    are sorted with their places in the low bits, and windows next to one of their
    hash are repeats. Their words are compared, and where two windows only share a
    hash the text's candidates are sorted by their words instead.
    """
    n = F.size(w)

    def windows(h):
        return F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))

    def alike(places, p, q):
        at = lambda x, k: F.get(w, x.bitwiseAND(places).cast("int") + k)
        return (at(p, 0) == at(q, 0)) & (at(p, 1) == at(q, 1)) & (at(p, 2) == at(q, 2))

    def by_words(p):
        at = lambda i, k: F.get(w, (i + k).cast("int"))
        text = F.sort_array(F.transform(p, lambda i: F.struct(F.concat_ws(" ", at(i, 0), at(i, 1), at(i, 2)).alias("t"), i.alias("i"))))
        same = lambda s, x, i: F.when(i > 0, F.get(s, i - 1)["t"] == x["t"]).otherwise(False) | F.coalesce(F.get(s, i + 1)["t"] == x["t"], F.lit(False))
        return let(text, lambda s: F.transform(F.filter(s, lambda x, i: same(s, x, i)), lambda x: x["i"]))

    def count(keys, places):
        twin = lambda x, y: x.bitwiseXOR(y).between(F.lit(0).cast("long"), places)
        ordered = F.sort_array(F.transform(keys, lambda x, i: x.bitwiseAND(F.bitwise_not(places)).bitwiseOR(i.cast("long"))))
        near = let(ordered, lambda s: F.filter(s, lambda x, i: twin(x, F.get(s, i + 1)) | twin(x, F.get(s, i - 1))))

        def found(s):
            sound = F.forall(F.transform(s, lambda x, i: ~F.coalesce(twin(x, F.get(s, i + 1)), F.lit(False)) | F.coalesce(alike(places, x, F.get(s, i + 1)), F.lit(True))), lambda x: x)
            return let(F.transform(s, lambda x: x.bitwiseAND(places)), lambda p: F.when(sound, p).otherwise(by_words(p)))

        return let(let(near, found), lambda p: F.size(F.array_union(F.array_union(p, F.transform(p, lambda x: x + 1)), F.transform(p, lambda x: x + 2))))

    def some(keys):
        places = F.pow(F.lit(2.0), F.length(F.bin(F.size(keys).cast("long")))).cast("long") - 1
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(places, lambda m: count(keys, m)))

    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(n >= 3, let(let(hashed, windows), some)).otherwise(0).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row, written to the shared folder."""
    text = F.coalesce(F.col("text"), F.lit(""))
    several = F.filter(F.split("t", "\n", -1), lambda x: bare(x) != "")
    lines = F.when(F.contains("t", F.lit("\n")), several).otherwise(F.filter(F.array("t"), lambda x: F.size("w") > 0))
    base = docs.select("doc_id", "lang", "source", text.alias("t"), words(text).alias("w"))
    out = base.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    return stash(out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words", F.col("lines.n").alias("n_lines")), "measures")


def thousandths(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.floor(1000 * F.col(part) / F.col(whole))).otherwise(0).cast("long")


def rounded(value: Column) -> Column:
    """A count rounded down to six significant bits."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0)).cast("int")
    unit = F.pow(F.lit(2.0), drop).cast("long")
    return F.floor(value / unit).cast("long") * unit


def fences(table: DataFrame) -> DataFrame:
    """lang, source, documents and the low and high fences of each measure, of every group."""
    values = F.array(*(F.struct(F.lit(k).alias("k"), rounded(F.col(name)).alias("v")) for k, (name, _, _) in enumerate(MEASURES)))
    sketch = table.where("n_words > 0").select("lang", "source", F.explode(values).alias("m")).groupBy("lang", "source", F.col("m.k").alias("k"), F.col("m.v").alias("v")).agg(F.count("*").alias("n"))
    sketch = stash(sketch, "sketch")
    null = F.lit(None).cast("string")
    by_lang = sketch.groupBy("lang", "k", "v").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", null.alias("source"), "k", "v", "n")
    by_all = sketch.groupBy("k", "v").agg(F.sum("n").alias("n")).select(F.lit(0).alias("level"), null.alias("lang"), null.alias("source"), "k", "v", "n")
    every = sketch.select(F.lit(2).alias("level"), "lang", "source", "k", "v", "n").unionByName(by_lang).unionByName(by_all)
    group = ["level", "lang", "source"]
    up = Window.partitionBy(*group, "k").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = every.withColumn("rank", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy(*group, "k")))
    at = lambda q: F.min(F.when(4 * F.col("rank") >= q * F.col("all"), F.col("v")))
    quartiles = ranked.groupBy(*group, "k").agg(F.max("all").alias("docs"), at(1).alias("low"), at(3).alias("high"))
    quartiles = stash(quartiles, "quartiles")

    def shrunk(own: DataFrame, larger: DataFrame, on: list[str]) -> DataFrame:
        """Quartiles of each group moved to those of the next larger sketch."""
        side = larger.select(*(F.col(c).alias(f"{c}_") for c in (*on, "k")), F.col("low").alias("low_"), F.col("high").alias("high_"))
        hit = functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*on, "k")))
        to = lambda c: F.expr(f"(docs * {c} + {PRIOR} * {c}_) div (docs + {PRIOR})").alias(c)
        return own.join(F.broadcast(side) if not on else side, hit).select(*group, "k", "docs", to("low"), to("high"))

    by_language = shrunk(quartiles.where("level = 1"), quartiles.where("level = 0"), [])
    by_group = shrunk(quartiles.where("level = 2"), by_language, ["lang"])
    least = F.element_at(F.array(*(F.lit(m[1]) for m in MEASURES)), F.col("k") + 1)
    wide = F.greatest(SPREAD * (F.col("high") - F.col("low")), least)
    fenced = by_group.withColumn("lo", F.col("low") - wide).withColumn("hi", F.col("high") + wide)
    of = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}")
    flat = fenced.groupBy("lang", "source").agg(F.max("docs").alias("docs"), *(of(c, k) for k in range(len(MEASURES)) for c in ("lo", "hi")))
    names = [f"{c}_{k}" for k in range(len(MEASURES)) for c in ("lo", "hi")]
    return flat.select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), F.col("docs").alias("fence_docs"), F.struct(*names).alias("fence"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the documents whose sketch the fences came from, of every row."""
    table = measured(docs)
    for name, part, whole in (("symbols", "n_symbols", "n_words"), ("dup_lines", "n_dup_lines", "n_lines"), ("repeats", "n_repeat_words", "n_words"), ("word_len", "word_chars", "n_words")):
        table = table.withColumn(name, thousandths(part, whole))
    limits = stash(fences(table), "limits")
    side = F.broadcast(limits) if fits(limits) else limits
    joined = table.join(side, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    inside = F.lit(True)
    for k, (name, _, below) in enumerate(MEASURES):
        inside = inside & (F.col(name) <= F.col(f"fence.hi_{k}"))
        if below:
            inside = inside & (F.col(name) >= F.col(f"fence.lo_{k}"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept"), F.coalesce("fence_docs", F.lit(0)).alias("fence_docs"),
    )


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dup
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g), range(3) x(k) WHERE c > 1 GROUP BY r),
m AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
      FROM t LEFT JOIN l USING (r) LEFT JOIN p USING (r)),
v AS (SELECT *, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS m0, CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS m1,
             CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS m2, CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS m3 FROM m),
e AS (SELECT lang, source, k, x // (2 ** greatest(length(bin(x)) - 6, 0))::BIGINT * (2 ** greatest(length(bin(x)) - 6, 0))::BIGINT AS v
      FROM (SELECT lang, source, unnest([0, 1, 2, 3]) AS k, unnest([m0, m1, m2, m3]) AS x FROM v WHERE n_words > 0)),
f AS (SELECT 2 AS level, lang, source, k, v FROM e UNION ALL SELECT 1, lang, NULL, k, v FROM e UNION ALL SELECT 0, NULL, NULL, k, v FROM e),
q AS (SELECT level, lang, source, k, count(*) AS docs, quantile_disc(v, 0.25) AS low, quantile_disc(v, 0.75) AS high FROM f GROUP BY ALL),
ql AS (SELECT n.lang, n.k, (n.docs * n.low + 100 * z.low) // (n.docs + 100) AS low, (n.docs * n.high + 100 * z.high) // (n.docs + 100) AS high
       FROM q n JOIN q z ON n.level = 1 AND z.level = 0 AND n.k = z.k),
qs AS (SELECT a.lang, a.source, a.k, a.docs, (a.docs * a.low + 100 * n.low) // (a.docs + 100) AS low, (a.docs * a.high + 100 * n.high) // (a.docs + 100) AS high
       FROM q a JOIN ql n ON a.level = 2 AND a.k = n.k AND a.lang IS NOT DISTINCT FROM n.lang),
f2 AS (SELECT lang, source, max(docs) AS docs, max(high + greatest(3 * (high - low), 100)) FILTER (k = 0) AS h0,
             max(high + greatest(3 * (high - low), 200)) FILTER (k = 1) AS h1, max(high + greatest(3 * (high - low), 250)) FILTER (k = 2) AS h2,
             max(high + greatest(3 * (high - low), 1500)) FILTER (k = 3) AS h3, max(low - greatest(3 * (high - low), 1500)) FILTER (k = 3) AS l3 FROM qs GROUP BY ALL),
o AS (SELECT v.*, f.docs AS fence_docs, h0, h1, h2, h3, l3, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
      FROM v LEFT JOIN f2 f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(m0 <= h0 AND m1 <= h1 AND m2 <= h2 AND m3 <= h3 AND m3 >= l3, false) AS kept, coalesce(fence_docs, 0)::BIGINT AS fence_docs
FROM o
"""
