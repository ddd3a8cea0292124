"""run() against its stages in plain Python, where a stage is exact, and against its own decisions where it is learned."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from symbolake.llm import decontaminate, jaccard_join, mixing, quality_model  # noqa: E402
from symbolake.llm.base import stash, table  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark):
    """The documents after each stage."""
    sf = "/root/testdata/sf0.01"
    out = [table(spark, sf, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stash(stage(spark, out[-1], sf), f"test-{name}"))
    return sf, out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_shape(steps):
    _, (first, *rest) = steps
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "ring_sharding"]
    assert all(df.columns == first.columns for df in rest[:-1])
    assert rest[-1].columns == [*first.columns, "shard", "slot", "home_shard"]


def test_decisions(spark, steps):
    sf, (docs, good, single, clean, mixed, sharded) = steps
    labels, bench = table(spark, sf, "labels"), table(spark, sf, "benchmark")
    scores = {r.doc_id: r.score for r in quality_model.classify(docs, labels).collect()}
    assert ids(good) == {d for d, s in scores.items() if s >= 0.3}
    components = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(good).collect()}
    assert ids(single) == {d for d, c in components.items() if d == c}
    assert ids(clean) == ids(single) - ids(decontaminate.find_leaks(single, bench))
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_table(clean).where("size > 0").collect()}
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter({d: n for d, n in taken.items() if n})
    counts = Counter(r.shard for r in sharded.select("shard").collect())
    assert sharded.count() == mixed.count() and max(counts.values()) - min(counts.values()) <= 1


def test_labels_are_kept(spark, steps):
    """Good documents stay in the filtering stages, bad ones go."""
    sf, (docs, good, *_) = steps
    labels = table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", "quality")
    kept = ids(good)
    rows = labels.collect()
    assert sum(r.doc_id in kept for r in rows if r.quality) > 0.99 * sum(bool(r.quality) for r in rows)
    assert sum(r.doc_id in kept for r in rows if not r.quality) < 0.1 * sum(not r.quality for r in rows)


def test_run_is_the_stages(spark, steps):
    sf, out = steps
    got = corpus_pipeline.run(spark, sf)
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "shard", F.xxhash64("text")).collect())
    assert key(got) == key(out[-1])


def test_pipeline_on_odd_documents(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        df = docs
        for name, stage in corpus_pipeline.STAGES:
            df = stash(stage(spark, df, sf), f"odd-{name}")
        assert set(docs.columns) <= set(df.columns)
