import numpy as np
import pytest
from pyspark.sql import functions as F

from symbolake.model import ENTRIES
from symbolake.operators import clusters, vectors
from symbolake.plans import indexing


def entries(spark, vs):
    return spark.createDataFrame([(f"k{i}", "ab"[i % 2], f"fn{i}", f"f{i % 5}", i, "", "", "h", None if v is None else [float(x) for x in v], i) for i, v in enumerate(vs)], ENTRIES)


def grouped(seed, n=240, groups=8, dim=12, spread=0.15):
    """Vectors near a few directions, with copies, absent ones and the centroid itself among them."""
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(groups, dim)) * 3
    vs = [middle[i % groups] + rnd.normal(size=dim) * spread for i in range(n)]
    vs[7], vs[8] = vs[0], vs[0]
    return [*vs[: n - 3], [], None, []]


def ids(df):
    return [(r.ord, round(r.score, 9)) for r in df.collect()]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    e = entries(spark, grouped(1))
    centre = vectors.centroid(e)
    path = str(tmp_path_factory.mktemp("clusters") / "i")
    clusters.build(e, centre, path, 9)
    return e.persist(), centre, clusters.load(spark, path)


@pytest.mark.parametrize("k, top, section", [(1.0, 8, None), (0.0, 3, "a"), (-9.0, 1000, None), (2.5, 8, "a"), (9.0, 8, None), (1.0, 0, None)])
def test_same_hits_as_a_scan(stored, k, top, section):
    e, centre, index = stored
    assert index.n == 240 and set(index.entries().columns) == set(e.columns)
    for q in (grouped(1)[3], np.ones(12)) if k == 1.0 else (grouped(1)[3],):
        got = clusters.search(index, [float(x) for x in q], k, top, section)
        assert ids(got.rows) == ids(vectors.search(e, [float(x) for x in q], centre, k, top, section))


def test_a_query_without_direction_reads_all(stored):
    e, centre, index = stored
    got = clusters.search(index, centre)
    assert got.clusters_read == got.clusters and ids(got.rows) == ids(vectors.search(e, centre, centre))


def test_clusters_are_left_unread(stored):
    _, _, index = stored
    got = clusters.search(index, [float(x) for x in grouped(1)[3]])
    assert got.clusters_read <= 2 < got.clusters
    plan = got.rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster" in plan or "PartitionFilters: [cluster" in plan


def test_bounds_hold(spark):
    """No member of a cluster scores above its bound, whatever the query."""
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(400, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    found = clusters.directions(v, 10)
    own = (v @ found.T).argmax(1)
    radius = np.array([clusters.radius_of((v[own == c] @ found[c]).min()) for c in range(len(found))])
    for q in [*v[:50], *-v[:50]]:
        most = clusters.bound(found @ q, radius)
        assert all((v[own == c] @ q <= most[c]).all() for c in range(len(found)))


def test_odd_indexes(spark, tmp_path):
    for name, vs in (("none", []), ("one", [[1.0, 0.0]]), ("equal", [[1.0, 2.0]] * 9), ("absent", [None, []] * 4 + [[1.0, 0.0]])):
        e = entries(spark, vs)
        centre = vectors.centroid(e) or [0.0, 0.0]
        clusters.build(e, centre, str(tmp_path / name))
        index = clusters.load(spark, str(tmp_path / name))
        assert ids(clusters.search(index, [1.0, 0.5]).rows) == ids(vectors.search(e, [1.0, 0.5], centre))
    with pytest.raises(ValueError):
        clusters.search(index, [1.0, 0.5], top=-1)
    with pytest.raises(ValueError):
        clusters.search(index, [1.0])
    assert clusters.load(spark, str(tmp_path / "nowhere")) is None


@pytest.mark.parametrize("block, count, k", [(2048, None, 2.0), (16, 8, 2.0), (7, 20, 0.0), (16, 8, -2.0)])
def test_same_pairs_as_all_blocks(spark, block, count, k):
    e = entries(spark, grouped(4, n=90))
    centre = vectors.centroid(e)
    got = clusters.similar_pairs(e, centre, k, block, count)
    want = vectors.similar_pairs(e, centre, k)
    rows = lambda df: sorted((r.a, r.b, round(r.score, 9)) for r in df.collect())
    assert rows(got.rows) == rows(want)
    if (block, k) == (16, 2.0):
        assert got.scored * 3 < got.possible


@pytest.mark.parametrize("vs", [[], [[1.0, 0.0]], [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]], np.eye(7).tolist()])
def test_few_or_equal_pairs(spark, vs):
    e = entries(spark, vs)
    centre = [0.0] * len(vs[0]) if vs else [0.0, 0.0]
    rows = lambda df: sorted((r.a, r.b) for r in df.collect())
    assert rows(clusters.similar_pairs(e, centre, 2, 2, 3).rows) == rows(vectors.similar_pairs(e, centre, 2, 2))


def test_stored_index_searches_its_clusters(spark, tmp_path):
    e = entries(spark, grouped(5))
    index = indexing.Index(e, "m", 12, 2, vectors.centroid(e))
    stored = indexing.load(spark, indexing.save(index, str(tmp_path / "store")))
    assert sorted(r.key for r in stored.rows.collect()) == sorted(r.key for r in e.collect())
    q = [float(x) for x in grouped(5)[3]]
    found = indexing.search(stored, q)
    assert ids(found) == ids(vectors.search(e, q, index.centroid))
    assert "PartitionFilters: []" not in found._jdf.queryExecution().executedPlan().toString()
    assert stored.rows.where(F.size("vector") > 0).count() == 237


@pytest.mark.parametrize("strip, tile", [(32768, 1 << 22), (40, 64)])
def test_links_are_the_pairs_counted(spark, monkeypatch, strip, tile):
    """Counts of links, by strips of blocks and without writing a pair, are those of the pairs."""
    for name, value in (("STRIP", strip), ("TILE", tile)):
        monkeypatch.setattr(vectors, name, value, raising=False)
    rnd = np.random.default_rng(8)
    rows = (rnd.normal(size=(200, 6)) + 3 * np.eye(6)[rnd.integers(0, 6, 200)]).tolist()
    rows[7] = rows[150] = rows[3]
    e = spark.createDataFrame([(i, str(i % 3), f"f{i % 9}", v) for i, v in enumerate(rows)], "ord long, section string, file string, vector array<double>")
    centre = vectors.centroid(e)
    pairs = [(r.a, r.b) for r in vectors.similar_pairs(e, centre, 1.0).collect()]
    count = lambda kept: {i: n for i in range(200) if (n := sum(i in p for p in kept))}
    links, own = count(pairs), count([p for p in pairs if p[0] % 9 == p[1] % 9])
    for got in (vectors.similar_links(e, centre, 1.0, block=16), clusters.similar_links(e, centre, 1.0, 16).rows):
        got = got.collect()
        assert {r.ord: r.links for r in got} == links and {r.ord: r.same_file for r in got if r.same_file} == own
    third = {r.ord: r.links for r in vectors.similar_links(e, centre, 1.0, "2", 16).collect()}
    assert third == count([p for p in pairs if p[0] % 3 == p[1] % 3 == 2])
    rows = {r.ord: (r.class_id, r.links) for r in vectors.with_links(e, vectors.similar_links(e, centre, 1.0)).collect()}
    assert len(rows) == 200 and {i for i, (c, _) in rows.items() if c == 3} == {3, 7, 150} and {i: n for i, (_, n) in rows.items() if n} == links
    none = spark.createDataFrame([], e.schema)
    assert vectors.similar_links(none, [], 1.0).count() == 0 and clusters.similar_links(none, [], 1.0).rows.count() == 0
