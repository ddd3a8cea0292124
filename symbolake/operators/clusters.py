"""Clusters of unit vectors with exact bounds: top-k search and pairs that leave out what cannot count.

Vectors are recentred as everywhere in this package and dealt to the nearest of a
few directions, found by spherical k-means over a sample. The sample only decides
how well the bounds cut; results do not depend on it. A cluster keeps the largest
angle r between its direction c and a member. For a unit query q at angle t from c
no member scores above cos(max(0, t - r)), and for two clusters at angle t no pair
scores above cos(max(0, t - r1 - r2)). Vectors without a direction (absent or equal
to the centroid) score 0 with everything and are a cluster of their own.

Search keeps one folder of Parquet files for each cluster. The gate needs the mean
and deviation of the scores of all vectors: with S their sum and G their Gram
matrix, both stored, the mean is q.S / n and the mean square q.G.q / n. Clusters are
read in order of their bound, until the best hits outscore every bound that is left
or the gate does. Where the closed form may round otherwise than a pass over all
rows (a tiny deviation, or a hit within rounding of the cutoff), all rows are read.

Bounds of the driver: CLUSTERS directions, SAMPLE_BYTES of sampled vectors, one row
for each cluster or block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolake.model import ENTRIES, GATE_MIN_POPULATION, SEARCH_K, SIMILAR_K, TOP_K
from symbolake.operators import vectors
from symbolake.operators.vectors import BLOCK

#: Most directions, bytes of vectors that they are fitted on, and rounds of fitting.
CLUSTERS, SAMPLE_BYTES, ROUNDS = 1024, 32 << 20, 8
#: Most blocks of pairs on a side; beyond, blocks grow.
BLOCKS = 8192
#: Rounding that a bound or a cutoff may carry.
SLACK = 1e-9
#: The cluster of vectors without a direction.
NONE = -1

STORED = f"{ENTRIES}, cosine double, cluster int"
NAMES = [f.split()[0] for f in ENTRIES.split(", ")]


def directions(sample: np.ndarray, count: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit directions by spherical k-means; the first ones are spread out, each far from those before it."""
    rnd = np.random.default_rng(seed)
    found = sample[:1]
    nearest = sample @ found[0] if len(sample) else np.zeros(0)
    while len(found) < min(count, len(sample)):
        gap = np.maximum(1 - nearest, 0) ** 2
        if not gap.sum() > SLACK:
            break
        new = sample[rnd.choice(len(sample), p=gap / gap.sum())]
        found = np.vstack([found, new])
        nearest = np.maximum(nearest, sample @ new)
    for _ in range(rounds if len(found) > 1 else 0):
        own = (sample @ found.T).argmax(1)
        moved = np.stack([sample[own == k].sum(0) if (own == k).any() else found[k] for k in range(len(found))])
        norm = np.linalg.norm(moved, axis=1, keepdims=True)
        found = np.where(norm > SLACK, moved / np.maximum(norm, SLACK), found)
    return found


def recentred_rows(entries: DataFrame, centre: list[float], *keep: str) -> DataFrame:
    """The kept columns and vector_r; zeros where a vector has no direction."""
    zero = F.array_repeat(F.lit(0.0), len(centre))
    r = vectors.recentre(entries, centre, out="r_")
    return r.select(*keep, F.when(F.size("r_") == 0, zero).otherwise(F.col("r_")).alias("vector_r"))


def fitted(moved: DataFrame, dim: int, n: int, count: int) -> np.ndarray:
    """Directions for (ord, vector_r), from a sample of at most SAMPLE_BYTES by the hash of ord."""
    share = max(1, -(-n * 8 * dim // SAMPLE_BYTES))
    some = moved.where(F.pmod(F.xxhash64("ord"), F.lit(share)) == 0).select("vector_r").limit(2 * SAMPLE_BYTES // (8 * max(dim, 1)))
    table = some.toArrow()
    sample = vectors._matrix(table["vector_r"], dim) if len(table) else np.zeros((0, dim))
    sample = sample[np.lexsort(sample.T)] if len(sample) else sample  # in no order but that of the values
    return directions(sample[np.linalg.norm(sample, axis=1) > 0.5], count)


def dealt(moved: DataFrame, centres: np.ndarray, dim: int) -> DataFrame:
    """Rows with vector_r, their cluster, and the cosine to its direction."""
    kind = T.StructType([*moved.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("cosine", T.DoubleType())])

    def run(batches):
        for batch in batches:
            v = vectors._matrix(batch.column("vector_r"), dim) if len(batch) else np.zeros((0, dim))
            own, best = np.full(len(v), NONE, np.int32), np.ones(len(v))
            if len(centres) and len(v):
                score = v @ centres.T
                own, best = score.argmax(1).astype(np.int32), score.max(1)
            lost = np.linalg.norm(v, axis=1) < 0.5
            own[lost], best[lost] = NONE, 1.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(best)], [*batch.schema.names, "cluster", "cosine"])

    return moved.mapInArrow(run, kind)


def bound(cosine: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The largest cosine at this angle less a radius (in radians)."""
    angle = np.arccos(np.clip(cosine, -1, 1)) - radius
    return np.cos(np.clip(angle - math.sqrt(SLACK) * 1e-3, 0, math.pi)) + SLACK


def radius_of(least: float) -> float:
    """The angle of the smallest cosine of a cluster, rounded up."""
    return math.acos(max(-1.0, min(1.0, least))) + 1e-7


# ---- search ------------------------------------------------------------------------


@dataclass
class SearchIndex:
    """Entries by cluster, and what bounds and gate need."""

    rows: DataFrame
    centre: list[float]
    n: int
    total: np.ndarray
    gram: np.ndarray
    ids: np.ndarray
    centres: np.ndarray
    radius: np.ndarray

    def entries(self, ids=None) -> DataFrame:
        """All entries, or those of some clusters; other clusters' files are not read."""
        rows = self.rows if ids is None else self.rows.where(F.col("cluster").isin([int(i) for i in ids]))
        return rows.select(*NAMES)


@dataclass
class Hits:
    rows: DataFrame
    clusters_read: int
    clusters: int


def build(entries: DataFrame, centre: list[float], path: str, count: int | None = None) -> None:
    """Write entries as a search index under ``path``; a large cluster is several files."""
    spark, dim = entries.sparkSession, len(centre)
    moved = recentred_rows(entries, centre, *NAMES)
    n, total, gram, _, _ = vectors.gram(moved, dim)
    centres = fitted(moved, dim, n, count or max(1, min(CLUSTERS, math.isqrt(n))))
    rows = dealt(moved, centres, dim).drop("vector_r")
    # rebalanced by cluster: small parts of one cluster meet in a file, a hot cluster is split by its size
    rows.hint("rebalance", "cluster").write.partitionBy("cluster").parquet(f"{path}/entries")
    spread = spark.read.schema(STORED).parquet(f"{path}/entries").groupBy("cluster").agg(F.min("cosine").alias("least"), F.count(F.lit(1)).alias("n")).orderBy("cluster").collect()  # one row a cluster
    made = [(int(r["cluster"]), centres[r["cluster"]].tolist() if r["cluster"] >= 0 else [0.0] * dim, radius_of(r["least"]), r["n"]) for r in spread]
    spark.createDataFrame(made, "cluster int, centre array<double>, radius double, n long").coalesce(1).write.parquet(f"{path}/clusters")
    stats = [(i, gram[i].tolist(), float(total[i]), float(centre[i]), n) for i in range(dim)]
    spark.createDataFrame(stats, "i int, gram array<double>, total double, centre double, n long").coalesce(1).write.parquet(f"{path}/gram")


def load(spark: SparkSession, path: str) -> SearchIndex | None:
    """The search index under a path, or None where entries were written without one."""
    try:
        made = spark.read.parquet(f"{path}/clusters").orderBy("cluster").collect()
        stats = spark.read.parquet(f"{path}/gram").orderBy("i").collect()
    except AnalysisException:
        return None
    rows = spark.read.schema(STORED).parquet(f"{path}/entries")
    dim = len(stats)
    return SearchIndex(
        rows, [r["centre"] for r in stats], stats[0]["n"] if stats else 0, np.array([r["total"] for r in stats]), np.array([r["gram"] for r in stats]).reshape(dim, dim),
        np.array([r["cluster"] for r in made]), np.array([r["centre"] for r in made]).reshape(-1, dim), np.array([r["radius"] for r in made]),
    )


def search(index: SearchIndex, query: list[float], k: float = SEARCH_K, top: int = TOP_K, section: str | None = None) -> Hits:
    """The rows of ``vectors.search`` over all entries, from the clusters that can hold them."""
    everything = lambda: Hits(vectors.search(index.entries(), query, index.centre, k, top, section), len(index.ids), len(index.ids))
    if top < 0 or len(query) != len(index.centre):
        return everything()  # the same errors
    q = np.array(query, float) - np.array(index.centre)
    norm = math.sqrt(float(q @ q))
    if not norm or not index.n:
        return everything()
    q = q / norm
    cutoff = -math.inf
    if index.n >= GATE_MIN_POPULATION:
        mean = float(q @ index.total) / index.n
        sd = math.sqrt(max(float(q @ index.gram @ q) / index.n - mean * mean, 0.0))
        if sd < 1e-4:
            return everything()
        cutoff = mean + k * sd
    most = np.where(index.ids == NONE, 0.0, bound(index.centres @ q, index.radius))
    order = [int(i) for i in np.lexsort((index.ids, -most)) if most[i] >= cutoff - SLACK]
    read, step, best = 0, 1, []
    while read < len(order) and not (len(best) >= top and (not top or most[order[read]] < best[top - 1] - SLACK)):
        own = order[read : read + step]
        found = vectors.scores(index.entries(index.ids[own]), query, index.centre).where(F.col("score") >= cutoff - SLACK)
        if section:
            found = found.where(F.col("section") == section)
        best = sorted([*best, *(r[0] for r in found.orderBy(F.desc("score")).limit(top).select("score").collect())], reverse=True)[:top]
        read, step = read + len(own), 3 * step
    if any(abs(s - cutoff) <= SLACK for s in best):
        return everything()
    hits = vectors.scores(index.entries(index.ids[order[:read]]), query, index.centre).where(F.col("score") >= cutoff)
    if section:
        hits = hits.where(F.col("section") == section)
    return Hits(hits.orderBy(F.desc("score"), "ord").limit(top), read, len(index.ids))


# ---- pairs -------------------------------------------------------------------------


@dataclass
class Pairs:
    rows: DataFrame
    blocks: int
    #: Pairs of blocks that were scored, of all.
    scored: int
    possible: int


@dataclass
class Blocks:
    """Vectors dealt to blocks, and what tells which blocks can hold pairs above the cutoff."""

    rows: DataFrame
    ids: np.ndarray
    sizes: list[int]
    cluster: np.ndarray
    middle: np.ndarray
    radius: np.ndarray
    base: float
    cutoff: float

    def near(self, i: int, others=slice(None)) -> np.ndarray:
        """Which blocks (by position) can hold a partner above the cutoff for block i."""
        most = bound(self.middle[others] @ self.middle[i], self.radius[others] + self.radius[i])
        return np.where((self.cluster[others] == NONE) | (self.cluster[i] == NONE), 0.0, most) >= self.base + self.cutoff - SLACK


def blocks_of(entries: DataFrame, centre: list[float], k: float, block: int, count: int | None, *keep: str) -> Blocks | None:
    """The blocks of ``similar_pairs``; None without rows."""
    dim = len(centre)
    moved = recentred_rows(entries, centre, "ord", *keep)
    n = entries.count()
    pairs, base, mean, sd = vectors.pair_statistics(moved, dim, block)
    cutoff = mean + k * sd if pairs >= GATE_MIN_POPULATION else -math.inf
    block = max(block, -(-n // BLOCKS))
    centres = fitted(moved, dim, n, count or max(1, min(CLUSTERS, -(-2 * n // block))))
    own = dealt(moved, centres, dim)
    sizes = own.groupBy("cluster").count().orderBy("cluster").collect()  # one row a cluster
    parts, at = [], 0
    for r in sizes:
        parts.append((r["cluster"], at, -(-r["count"] // block)))
        at += parts[-1][2]
    if not at:
        return None
    numbers = entries.sparkSession.createDataFrame(parts, "cluster int, first int, parts long")
    blocked = own.join(F.broadcast(numbers), "cluster").withColumn("b_", F.col("first") + F.pmod(F.xxhash64("ord"), "parts").cast("int"))
    spread = blocked.groupBy("b_").agg(F.first("cluster").alias("cluster"), F.min("cosine").alias("least"), F.count(F.lit(1)).alias("n")).orderBy("b_").collect()  # one row a block
    cluster = np.array([r["cluster"] for r in spread])
    radius = np.array([radius_of(r["least"]) for r in spread])
    ids = np.array([r["b_"] for r in spread])
    middle = centres[np.maximum(cluster, 0)] if len(centres) else np.zeros((len(ids), dim))
    return Blocks(blocked, ids, [r["n"] for r in spread], cluster, middle, radius, base, cutoff)


def similar_pairs(entries: DataFrame, centre: list[float], k: float = SIMILAR_K, block: int = BLOCK, count: int | None = None) -> Pairs:
    """The rows of ``vectors.similar_pairs``: (a, b, score) above the gate, from the blocks of vectors that can hold such pairs.

    A block is a cluster, or a part of one by the hash of ``ord`` where it has more
    than ``block`` members. In the worst case (no two blocks far apart) every pair of
    blocks is scored, as without clusters.
    """
    made = blocks_of(entries, centre, k, block, count)
    if made is None:
        return Pairs(entries.sparkSession.createDataFrame([], "a long, b long, score double"), 0, 0, 0)
    blocked, ids, base, cutoff = made.rows, made.ids, made.base, made.cutoff
    links = [(int(b), [int(x) for x in ids[made.near(i)]]) for i, b in enumerate(ids)]
    scored = sum(sum(x >= b for x in other) for b, other in links)
    partners = entries.sparkSession.createDataFrame(links, "b_ int, others array<int>")
    sides = blocked.join(partners, "b_").select("ord", "vector_r", "b_", F.explode("others").alias("o_"))
    sides = sides.select("ord", "vector_r", "b_", F.least("b_", "o_").alias("i"), F.greatest("b_", "o_").alias("j"))

    def above(rows: pa.Table) -> pa.Table:
        a, b, s = vectors._block_scores(rows)
        keep = s - base >= cutoff
        return pa.table({"a": a[keep], "b": b[keep], "score": s[keep]})

    found = sides.groupBy("i", "j").applyInArrow(above, "a long, b long, score double")
    return Pairs(found, len(ids), scored, len(ids) * (len(ids) + 1) // 2)


def similar_links(entries: DataFrame, centre: list[float], k: float = SIMILAR_K, block: int = BLOCK, count: int | None = None) -> Pairs:
    """The ``vectors.link_counts`` of those pairs, from the same blocks; strips of blocks are shuffled and no pair is written."""
    made = blocks_of(entries, centre, k, block, count, "file")
    if made is None:
        return Pairs(entries.sparkSession.createDataFrame([], "ord long, links long, same_file long"), 0, 0, 0)
    place = entries.sparkSession.createDataFrame([(int(b), i) for i, b in enumerate(made.ids)], "b_ int, at_ int")
    rows = made.rows.join(F.broadcast(place), "b_").drop("b_").withColumnRenamed("at_", "b_")
    scored = sum(int(made.near(i)[i:].sum()) for i in range(len(made.ids)))
    facts = Blocks(None, made.ids, made.sizes, made.cluster, made.middle, made.radius, made.base, made.cutoff)
    found = vectors.link_counts(rows, vectors.strips_of(made.sizes), made.base, made.cutoff, facts.near)
    return Pairs(found, len(made.ids), scored, len(made.ids) * (len(made.ids) + 1) // 2)
