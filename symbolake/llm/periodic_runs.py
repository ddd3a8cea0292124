"""Runs of repeated word periods, found over a harmonic grid of suffix-array queries.

A run is a stretch of words with smallest period q, at least max(MIN_WORDS,
MIN_EXPONENT * q) words long, which no neighbouring word extends. For each period p
the places 0, p, 2p, ... are a grid; a stretch of two periods or more holds two
neighbouring places of it. So the longest common extensions of jp and (j+1)p,
forward and backward, give every stretch of period p. An extension is the minimum
of a range of an LCP array (sparse table, constant time), forward over the suffix
array, backward over that of the reversed words. The grid of a text of n words has
about n ln n pairs, and only pairs of equal words are asked. A stretch found with
several periods keeps the smallest, which divides the others.

The texts of an Arrow batch are indexed together, a few hundred thousand words at a
time (a longer text alone); ranks start with the text's number, so that no
extension leaves its text. Suffixes are sorted by doubling, and only those that
still share their prefix are sorted again. LCPs are read from the ranks of the
doublings. Arrays take some 12 bytes a word for each doubling that a text needs.

Edge cases: null, empty and blank texts have no words and no runs. Words are told
apart by their bytes (ASCII white space between them). Texts of one repeated word
are one run of period 1. Rows with equal doc_id are taken one by one, as is a null
doc_id. An empty table gives no rows. Other columns are kept, but for those named
like a result, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolake.llm.base import let, small_batches, words
from symbolake.llm.textkernel import valid

MIN_WORDS, MIN_EXPONENT = 6, 4
#: Words that one index may hold (a longer text is one index), and grid pairs looked at together.
CHUNK, PAIRS = 1 << 17, 1 << 20

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
ADDED = T.StructType([T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
_ARROW_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


class Extensions:
    """Longest common extensions to the right within each text of a sequence of ids.

    ``text`` is the number of the text at each place, ascending. Suffixes are ranked
    by doubling; ``lcp`` between neighbours in their order is read from the ranks.
    """

    def __init__(self, ids: np.ndarray, text: np.ndarray):
        n = len(ids)
        # one end mark after each text, below all of its words
        ends = np.flatnonzero(np.diff(text)) + 1
        shift = np.zeros(n, np.int64)
        shift[ends] = 1
        self.place = np.arange(n) + np.cumsum(shift)
        size = n + len(ends) + 1
        width = int(ids.max(initial=0)) + 2
        key = np.empty(size, np.int64)
        key[self.place] = text * width + ids + 1
        mark = np.ones(size, bool)
        mark[self.place] = False
        texts = text[np.append(ends - 1, n - 1)] if n else np.zeros(1, np.int64)
        key[mark] = texts * width
        order = np.argsort(key, kind="stable")
        rank, tied = self._ranked(order, np.arange(size), key[order], np.empty(size, np.int32))
        levels, step = [rank.copy()], 1
        while len(tied):
            # suffixes of one group lie side by side in the order, at rank and on
            key = rank[tied].astype(np.int64) * size + rank[tied + step]
            inner = np.argsort(key, kind="stable")
            group = rank[tied[inner]]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            slot = group + np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            order[slot] = tied[inner]
            rank, tied = self._ranked(tied[inner], slot, key[inner], rank)
            levels.append(rank.copy())
            step *= 2
        self.rank = rank
        self.table = [self._lcp(order, levels)]
        while (width := 1 << len(self.table)) < size and self.table[-1].any():
            last = self.table[-1]
            self.table.append(np.minimum(last[: len(last) - width // 2], last[width // 2 :]))

    @staticmethod
    def _ranked(places, slots, keys, rank):
        """Ranks with these places set to the slot of the first equal key, and the places that share theirs."""
        new = np.append(True, keys[1:] != keys[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(keys)))
        rank[places] = np.repeat(slots[first], count)
        return rank, places[np.repeat(count > 1, count)]

    @staticmethod
    def _lcp(order, levels):
        """Words that each suffix shares with the one before it in the order."""
        lcp = np.zeros(len(order), np.int32)
        left, right = order[:-1], order[1:]
        at = np.flatnonzero(levels[0][left] == levels[0][right])
        x, y, total = left[at].copy(), right[at].copy(), np.zeros(len(at), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][x] == levels[k][y]
            x[same] += 1 << k
            y[same] += 1 << k
            total[same] += 1 << k
        lcp[at + 1] = total
        return lcp

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j (places in ids, i != j) share."""
        a, b = self.rank[self.place[i]], self.rank[self.place[j]]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(i), np.int32)
        for k in np.unique(level):
            if k < len(self.table):  # a level that was not built holds zeros only
                at = np.flatnonzero(level == k)
                row = self.table[k]
                out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out


def grid(first: np.ndarray, sizes: np.ndarray):
    """Yield (text, period, place) arrays of all pairs jp, (j+1)p of all texts, about PAIRS at a time."""
    most = np.where(sizes >= MIN_WORDS, np.maximum(sizes // MIN_EXPONENT, 1), 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    pairs = (sizes[text] - 1) // period
    total = np.cumsum(pairs)
    begin = 0
    while begin < len(text):
        done = total[begin - 1] if begin else 0
        end = max(int(np.searchsorted(total, done + PAIRS, "right")), begin + 1)
        own = pairs[begin:end]
        t, p = np.repeat(text[begin:end], own), np.repeat(period[begin:end], own)
        j = np.arange(len(t)) - np.repeat(np.cumsum(own) - own, own)
        yield t, p, first[t] + j * p
        begin = end


def find_runs(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of every run of texts that lie one behind the other in ``ids``, in this order."""
    first = np.cumsum(sizes) - sizes
    n = len(ids)
    found: list[np.ndarray] = []
    forward = backward = None
    for t, p, at in grid(first, sizes):
        same = ids[at] == ids[at + p]
        t, p, at = t[same], p[same], at[same]
        if not len(at):
            continue
        if forward is None:
            text = np.repeat(np.arange(len(sizes)), sizes)
            forward = Extensions(ids, text)
            backward = Extensions(ids[::-1], (len(sizes) - 1) - text[::-1])
        ahead = forward(at, at + p)
        # back from the places themselves: they are equal, and are counted in both
        back = backward(n - 1 - at, n - 1 - (at + p))
        length = ahead.astype(np.int64) + back - 1 + p
        keep = (length >= MIN_EXPONENT * p) & (length >= MIN_WORDS)
        if keep.any():
            rows = np.stack([t, at - back + 1 - first[t], length, p], 1)[keep]
            found.append(_smallest(rows))
    rows = _smallest(np.concatenate(found)) if found else np.zeros((0, 4), np.int64)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3]


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of each stretch the row with the smallest period."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1))]


def kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:n]) == 0


def chunks(counts: list[int]):
    """Ranges of texts of about CHUNK words together."""
    begin = total = 0
    for i, c in enumerate(counts):
        if i > begin and total + c > CHUNK:
            yield begin, i
            begin, total = i, 0
        total += c
    if begin < len(counts):
        yield begin, len(counts)


def analysed(texts: pa.Array) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs and collapsed text of every text of a batch."""
    out = []
    raw = valid(texts).cast(pa.large_binary())
    split = [x.as_py().split() for x in raw]  # bytes split at ASCII white space
    for lo, hi in chunks([len(w) for w in split]):
        own = split[lo:hi]
        sizes = np.array([len(w) for w in own], np.int64)
        flat = pa.array([x for w in own for x in w], pa.large_binary())
        ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text, start, length, period = find_runs(ids, sizes)
        edge = np.searchsorted(text, np.arange(len(own) + 1))
        for k, w in enumerate(own):
            a, b = edge[k], edge[k + 1]
            if a == b:
                out.append(([], b" ".join(w)))
                continue
            s, n, q = start[a:b], length[a:b], period[a:b]
            stays = kept(len(w), s, n, q)
            out.append((list(zip(s.tolist(), n.tolist(), q.tolist(), strict=True)), b" ".join([x for x, y in zip(w, stays.tolist(), strict=True) if y])))
    return out


def detect(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with runs (start, length, period; by start, then period) and collapsed, the kept words joined by one space."""
    small_batches(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED.names))

    def batches(it):
        for batch in it:
            rows = analysed(batch.column("text"))
            runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x, _ in rows], pa.list_(_ARROW_RUN))
            text = pa.array([x for _, x in rows], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, runs, text], [*batch.schema.names, *ADDED.names])

    return docs.mapInArrow(batches, T.StructType([*docs.schema.fields, *ADDED.fields]))


def strongest(runs):
    """The run of greatest length / period; ties: smallest start, then period."""
    ahead = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"])
    # runs come by start and period, so of equal ones the first stays
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | ahead(r, best), r).otherwise(best))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_runs, the strongest run, and SHA-256 of all runs and of the collapsed text."""
    out = detect(docs.select("doc_id", "text"))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    best = out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
    return best.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row, where one text in ten gets a periodic tail that its doc_id fixes.

    With h the CRC-32 of the decimal doc_id and g = h / 10: if h ends in 0, each word
    from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8).
    A null doc_id has no decimal, and its text stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.expr("h div 10")
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("g", g)

    def tailed(w):
        n = F.nullif(F.size(w).cast("long"), F.lit(0).cast("long"))
        a = F.col("g") % n
        p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
        again = let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.transform(w, lambda word, i: F.when(i < x["a"], word).otherwise(F.get(w, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))))
        return F.coalesce(F.array_join(again, " "), F.lit(""))

    return rows.select("doc_id", F.when(F.col("h") % 10 == 0, let(words(F.col("text")), tailed)).otherwise(F.col("text")).alias("text"))



ORACLE = r"""
WITH c AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: list_concat([ascii(x)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))),
                      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295::BIGINT) AS h FROM documents),
a AS (SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS k FROM c),
b AS (SELECT r, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) ELSE w END AS w FROM a),
e AS (SELECT r, n, w[i + 1] AS x, i FROM (SELECT r, n, w, unnest(range(n)) AS i FROM b)),
p AS (SELECT a.r, a.i, b.i - a.i AS p FROM e a JOIN e b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND b.i <= a.i + a.n // 4),
s AS (SELECT r, p, min(i) AS s, count(*) + p AS l FROM (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS g FROM p) GROUP BY r, p, g),
u AS (SELECT r, s, l, min(p) AS p FROM s WHERE l >= greatest(6, 4 * p) GROUP BY r, s, l),
t AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS lines, list({'s': s, 'l': l, 'p': p} ORDER BY l::DOUBLE / p DESC, s, p)[1] AS best,
             list({'a': s + p, 'z': s + l}) AS gone FROM u GROUP BY r),
x AS (SELECT e.r, string_agg(e.x, ' ' ORDER BY e.i) AS kept FROM e LEFT JOIN t USING (r) WHERE t.r IS NULL OR NOT coalesce(list_bool_or(list_transform(t.gone, lambda g: e.i >= g.a AND e.i < g.z)), false) GROUP BY e.r)
SELECT b.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period, (1000 * best.l // best.p)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM b LEFT JOIN t USING (r) LEFT JOIN x USING (r)
"""
