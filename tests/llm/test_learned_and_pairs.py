import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from symbolake.llm import components as cc
from symbolake.llm import decontaminate, jaccard_join, quality_model, token_files
from symbolake.llm.textkernel import EXACT, buffers, shingle_sets, word_hashes

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], KIND)


# ---- Jaccard join --------------------------------------------------------------------


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id -> (size, component) by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    top = {i: i for i, _ in rows}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and 100 * len(a & b) >= 75 * len(a | b):
                p, q = root(i), root(j)
                top[max(p, q)] = min(p, q)
    return {(i, len(s), root(i)) for i, s in sets}


def near_copies(rnd, n, length, edits):
    base = [f"b{rnd.randint(0, 400)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = [*base]
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 60)}"
        out.append(" ".join(w))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = near_copies(rnd, 70, 60, 4) + near_copies(rnd, 40, 14, 2) + near_copies(rnd, 30, 200, 9)
    texts += [passage + " " + " ".join(f"q{rnd.randint(0, 9)}" for _ in range(rnd.randint(0, 25))) for _ in range(60)]
    texts += [" ".join(f"s{rnd.randint(0, 3)}" for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    texts += rnd.sample(texts, 30) + ["", None, "  ", texts[0].upper(), texts[0].replace(" ", "\n\t")]
    return [*enumerate(texts)]


@pytest.mark.parametrize("seed, settings", [
    (1, {}),
    (2, {"FREQUENT": 2}),
    (3, {"FREQUENT": 2, "SUBCLASSES": 4, "LISTED": 5, "BLOCK": 8}),
    (4, {"FREQUENT": 3, "COMBINE": 3, "SUBCLASSES": 2, "LISTED": 3, "BLOCK": 16}),
    (5, {"FREQUENT": 0, "BITMAP_BITS": 16, "LISTED": 2, "BLOCK": 4}),
    (6, {"PACK": 500, "RANGE": 500, "FREQUENT": 4}),
    (7, {"PACK": 3000, "LISTED": 3, "BLOCK": 8}),
    (8, {"PACK": 800, "LISTED": 2, "FREQUENT": 2, "BLOCK": 8}),
    (9, {"PACK": 9000, "LISTED": 2, "FREQUENT": 3, "SUBCLASSES": 4, "BLOCK": 4}),
])
def test_join_loses_no_link(spark, monkeypatch, seed, settings):
    for k, v in settings.items():
        monkeypatch.setattr(jaccard_join, k, v)
    rows = corpus(seed)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_join_in_many_packs_and_shuffled_lookups(spark, monkeypatch):
    monkeypatch.setattr("symbolake.llm.base.BROADCAST_BYTES", 0)
    rows = corpus(9)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert {tuple(r) for r in got.collect()} == brute(rows)


@pytest.mark.parametrize("size, bits", [(900, 27), (900, 6), (0, 14)])
def test_more_ids_than_a_broadcast_move_no_text(spark, monkeypatch, odd_docs, size, bits):
    """Ids beyond a broadcast select texts by a bitmap; where the bitmap is crowded or all ids share places, results stay."""
    monkeypatch.setattr("symbolake.llm.base.BROADCAST_BYTES", size)
    monkeypatch.setattr(jaccard_join, "MARK_BITS", bits, raising=False)
    rows = corpus(11)
    rows += [(i + 1000, t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert {tuple(r) for r in jaccard_join.jaccard_components(docs).collect()} == want
    kept = jaccard_join.keep_first(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in want if i == c)
    if bits == 27:
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    kept = jaccard_join.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 9, 10]


def test_signature_pigeonhole():
    """Any two sets that link share a key or are both out of the index's reach only when equal."""
    rnd = np.random.default_rng(4)
    universe = np.sort(rnd.integers(0, 2**63, 700, dtype=np.uint64) * np.uint64(2))
    kind = rnd.integers(0, 3, 700)  # 0 unique is not shared by construction below
    for _ in range(600):
        n = int(rnd.integers(3, 260))
        core = rnd.choice(np.flatnonzero(kind > 0), n, replace=False)
        drop = int(rnd.integers(0, max(1, n // 5)))
        a = np.sort(core[drop // 2 :])
        b = np.sort(core[: n - (drop - drop // 2)])
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both) or len(a) == len(b) == both:
            continue
        keys = [set(np.concatenate(jaccard_join.keys_of(universe[x], np.ones(len(x), bool), kind[x] == 2)).tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_join_odd(spark, odd_docs, no_docs):
    got = jaccard_join.jaccard_components(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[8] == {(1, 7)} and by[None] == {(1, None)}
    assert {c for _, c in by[6]} == {5} and by[9] == {(1, 9)}
    assert jaccard_join.jaccard_components(no_docs).count() == 0
    kept = jaccard_join.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 9, 10]


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(1000, i) for i in range(900, 1000)] + [(i, i + 1) for i in range(2000, 2050)] + [(5, 5), (None, 3)]
    got = {r.id: r.component for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    top = {}
    root = lambda x: x if top.get(x, x) == x else root(top[x])
    for a, b in links:
        if a is not None:
            p, q = root(a), root(b)
            top[max(p, q)] = min(p, q)
    assert all(got.get(x, x) == root(x) for p in links for x in p if x is not None)
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingle_kernel_on_odd_texts():
    texts = ["a b c d e f", "a b c d e f ", "", None, " x ", "a b c d e", "A B C D E f", "ab c", "a bc", "\x0ba\x1cb"]
    sets = {i: s for i, s in shingle_sets(pa.array(texts))}
    assert [len(sets[i]) for i in range(len(texts))] == [2, 2, 0, 0, 1, 1, 2, 1, 1, 1]
    assert (sets[0] == sets[1]).all() and (sets[0] == sets[6]).all() and sets[7] != sets[8]


# ---- decontamination -----------------------------------------------------------------


def distance(item, window):
    row = [*range(len(window) + 1)]
    for i, x in enumerate(item, 1):
        last, row = row, [i]
        for j, y in enumerate(window, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def norm(text):
    return decontaminate.plain(pa.array([text]))[0].as_py().split()


def edited(rnd, words, k):
    w = [*words]
    for _ in range(k):
        at = rnd.randrange(len(w))
        kind = rnd.randrange(3)
        if kind == 0:
            w[at] = f"zz{rnd.randint(0, 999)}"
        elif kind == 1:
            w.insert(at, f"yy{rnd.randint(0, 999)}")
        else:
            del w[at]
    return w


@pytest.fixture(scope="module")
def bench(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def test_leaks_and_recall(spark, bench):
    """Nothing false, and at the largest allowed distance at least 0.9 of planted passages are found."""
    rnd = random.Random(7)
    items = {r.item_id: r.text.split() for r in bench.collect()}
    texts, planted = [], []
    for i, w in items.items():
        for share in (0, 0.5, 1, 1, 1, 1):
            k = int(share * int(decontaminate.EDITS * len(norm(" ".join(w)))))
            filler = [f"f{rnd.randint(0, 10**6)}" for _ in range(80)]
            planted.append((len(texts), i, share))
            texts.append(" ".join([*filler[:40], *edited(rnd, w, k), *filler[40:]]))
    clean = len(texts)
    texts += [" ".join(f"g{rnd.randint(0, 10**6)}" for _ in range(300)) for _ in range(100)]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(table(spark, texts), bench).collect()}
    assert all(d < clean for d, _ in got)
    for (d, i), r in got.items():
        window = norm(texts[d])[r.start_word : r.end_word]
        assert distance(norm(" ".join(items[i])), window) == r.distance <= decontaminate.EDITS * len(norm(" ".join(items[i])))
    for share, least in ((0, 1.0), (0.5, 0.97), (1, 0.9)):
        own = [(d, i) in got for d, i, s in planted if s == share]
        assert sum(own) >= least * len(own)


def test_leaks_by_brute_force(spark, sf, bench):
    """Every document of the table that holds an item word for word is found, and every find is real."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = {r.item_id: norm(r.text) for r in bench.collect()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    for r in docs.collect():
        w = " " + " ".join(norm(r.text)) + " "
        for i, item in items.items():
            if f" {' '.join(item)} " in w:
                assert (r.doc_id, i) in got
    kept = {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_leaks_odd(spark, bench, odd_docs, no_docs):
    items = [(1, None), (2, ""), (3, "too short"), (None, "w1 " * 30), (4, bench.first().text), (5, bench.first().text)]
    few = spark.createDataFrame(items, "item_id long, text string")
    text = bench.first().text
    got = decontaminate.find_leaks(spark.createDataFrame([(1, text.upper()), (1, text), (None, text), (2, None)], "doc_id long, text string"), few).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.distance) for r in got) == [(0, 4, 0), (0, 5, 0), (1, 4, 0), (1, 4, 0), (1, 5, 0), (1, 5, 0)]
    assert decontaminate.find_leaks(odd_docs, bench).count() == 0 and decontaminate.find_leaks(no_docs, bench).count() == 0
    kept = decontaminate.drop_leaks(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(odd_docs, none).count() == 0 and decontaminate.drop_leaks(odd_docs, none).count() == odd_docs.count()


def test_blocks_of_items(spark, bench, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 200)
    texts = [r.text for r in bench.collect()]
    got = decontaminate.find_leaks(table(spark, texts), bench)
    assert len([*decontaminate.blocks(bench)]) > 3 and got.where("distance = 0").select("doc_id").distinct().count() == len(texts)


def plain_leaks(item, text, k):
    """The least (distance, start, end) of all windows, if within k edits."""
    best = min(((distance(item, text[s:e]), s, e) for s in range(len(text)) for e in range(s, min(len(text), s + len(item) + k) + 1)), default=(k + 1,))
    return best if best[0] <= k else None


def block_of(items, edits=None):
    sequences = [word_hashes(*buffers(pa.array([" ".join(x)])), EXACT)[0] for x in items]
    return decontaminate.Block([*range(len(items))], sequences, decontaminate.EDITS if edits is None else edits)


@pytest.mark.parametrize("settings", [{}, {"HELD": 64}, {"SLICE": 16}])
def test_leaks_against_all_windows(monkeypatch, settings):
    """Against comparing every window, also among few words, at the ends of texts and in small slices: nothing false, nearly all found."""
    for k, v in settings.items():
        monkeypatch.setattr(decontaminate, k, v)
    rnd, found, best, all_ = random.Random(5), 0, 0, 0
    for trial in range(30):
        word = lambda v=(2, 5, 40)[trial % 3]: f"w{rnd.randint(0, v)}"
        items = [[word() for _ in range(rnd.randint(8, 16))] for _ in range(4)]
        texts = []
        for _ in range(4):
            w = [*rnd.choice(items)]
            for _ in range(int(decontaminate.EDITS * len(w)) + rnd.randint(-1, 1)):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randint(0, 1)] = [word()] * rnd.randint(0, 1)
            texts.append([word() for _ in range(rnd.choice([0, 2, 12]))] + w + [word() for _ in range(rnd.choice([0, 2, 12]))])
        got = decontaminate.leaks(block_of(items), pa.array([" ".join(t) for t in texts]))
        plain = {(t, i): plain_leaks(item, text, int(decontaminate.EDITS * len(item))) for t, text in enumerate(texts) for i, item in enumerate(items)}
        plain = {k: v for k, v in plain.items() if v}
        assert all(distance(items[i], texts[t][s:e]) == d >= plain[t, i][0] for (t, i), (d, s, e) in got.items())
        found, best, all_ = found + len(got), best + sum(got.get(k) == v for k, v in plain.items()), all_ + len(plain)
    assert all_ > 100 and found >= 0.98 * all_ and best >= 0.97 * all_


@pytest.mark.parametrize("length", [8, 10, 15, 20, 40, 60, 100, 200, 400, 800])
def test_recall_by_length(length):
    """Copies with as many edits as an item allows are found, however long it is."""
    rnd = random.Random(length)
    items = [[f"w{rnd.randint(0, 3000)}" for _ in range(length)] for _ in range(100)]
    filler = lambda: [f"f{rnd.randint(0, 10**6)}" for _ in range(40)]
    texts = [[*filler(), *edited(rnd, w, int(decontaminate.EDITS * length)), *filler()] for w in items]
    got = decontaminate.leaks(block_of(items), pa.array([" ".join(t) for t in texts]))
    assert len({(i, i) for i in range(len(items))} & set(got)) >= 98


@pytest.mark.parametrize("length", [10, 15, 20])
def test_recall_when_edits_are_spread_evenly(length):
    """The worst case: each window of an item has as many edits as any."""
    rnd = random.Random(length)
    k = int(decontaminate.EDITS * length)
    items = [[f"w{rnd.randint(0, 3000)}" for _ in range(length)] for _ in range(200)]
    texts = []
    for w in items:
        w = [*w]
        for at in sorted((rnd.randrange(j * length // k, (j + 1) * length // k) for j in range(k)), reverse=True):
            w[at : at + rnd.randint(0, 1)] = [f"zz{rnd.randint(0, 999)}"] * rnd.randint(0, 1)
        texts.append([f"f{rnd.randint(0, 10**6)}" for _ in range(9)] + w + [f"f{rnd.randint(0, 10**6)}" for _ in range(9)])
    got = decontaminate.leaks(block_of(items), pa.array([" ".join(t) for t in texts]))
    assert len({(i, i) for i in range(len(items))} & set(got)) >= 196


def test_one_edit_against_plain():
    """What stands in a text with one edit is kept, whatever the edit; two edits that are not one are not."""
    rnd = random.Random(3)
    for _ in range(300):
        item = [rnd.randint(1, 50) for _ in range(9)]
        left = rnd.randint(4, 9)
        for edits in (0, 1):
            own = edited(rnd, [str(x) for x in item[:left]], edits)
            text = np.array([int("".join(c for c in x if c.isdigit())) + 100 * (not x.isdigit()) for x in own] + item[left:] + [0] * 9, np.int32)
            assert decontaminate.one_edit(np.array(item, np.int32), np.array([0]), np.array([left]), text, np.array([0]))[0]
        other = np.array([-x if j in (1, left - 2) else x for j, x in enumerate(item)] + [0] * 9, np.int32)
        if left > 5 and len(set(item)) == 9:
            assert not decontaminate.one_edit(np.array(item, np.int32), np.array([0]), np.array([left]), other, np.array([0]))[0]


def test_words_of_any_script():
    words = decontaminate.plain(pa.array(["It's É-cole, 42!", "it S école 42", None, "РУС “рус”", "一丠 ab一", "x\u200by"])).to_pylist()
    assert [w.split() for w in words] == [["it", "s", "é", "cole", "42"], ["it", "s", "école", "42"], [], ["рус", "рус"], ["一", "丠", "ab", "一"], ["x", "y"]]
    bad = pa.array([b"one \xff two", b"three"]).cast(pa.binary()).view(pa.string())
    assert [w.split() for w in decontaminate.plain(bad).to_pylist()] == [["one", "two"], ["three"]]


def test_a_very_long_text_is_read_in_slices(monkeypatch):
    monkeypatch.setattr("symbolake.llm.textkernel.CHUNK", 1000)
    rnd = random.Random(2)
    item = [f"w{k}" for k in range(30)]
    text = [f"f{rnd.randint(0, 999)}" for _ in range(4000)] + item + ["x" * 5000] + item[:29]
    got = decontaminate.leaks(block_of([item]), pa.array([" ".join(text)]))
    assert got == {(0, 0): (0, 4000, 4030)}


@pytest.mark.parametrize("length", [5, 6, 7, 8, 9])
def test_one_edit_of_short_items(length):
    """From five words on an item allows one edit, at any place and of any kind."""
    rnd = random.Random(length)
    items, texts = [[f"w{rnd.randint(0, 300)}" for _ in range(length)] for _ in range(40)], []
    for w in items:
        for at in range(length):
            for new in ([], ["zz"], ["zz", w[at]]):
                texts.append(["f1", "f2", *w[:at], *new, *w[at + 1 :], "f3"])
    got = decontaminate.leaks(block_of(items), pa.array([" ".join(t) for t in texts]))
    plain = {(t, t // (3 * length)): plain_leaks(items[t // (3 * length)], text, 1) for t, text in enumerate(texts)}
    assert all(plain.values())
    found = sum(got.get(k) == v for k, v in plain.items())
    assert found == len(plain) if length < decontaminate.HALVED_BELOW else found >= 0.97 * len(plain)
    assert not any(plain_leaks(items[i], texts[t], 1) is None for t, i in got)


def test_short_items(spark):
    items = [["yes"], ["w1", "w2"], ["a", "b", "c"], ["q1", "q2", "q3", "q4", "q5"], [f"s{k}" for k in range(7)]]
    texts = ["no", "yes", "x W1, w2 y", "w1 x w2", "a b c a b c", "q1 q2 q3 q4", "q1 q2 q3 q4 q5", "s0 s1 s2 s3 s4 s5 s6", "s0 s1 s2 x s4 s5 s6", "a b", "c yes"]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = table(spark, texts)
    got = {(r.doc_id, r.item_id): (r.start_word, r.end_word, r.distance) for r in decontaminate.find_leaks(docs, bench).collect()}
    exact = {(1, 0): (0, 1, 0), (2, 1): (1, 3, 0), (4, 2): (0, 3, 0), (6, 3): (0, 5, 0), (7, 4): (0, 7, 0), (10, 0): (1, 2, 0)}
    assert got == exact | {(5, 3): (0, 4, 1), (8, 4): (0, 7, 1)}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()} == {0, 3, 9}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench, min_words=5).collect()} == {0, 1, 2, 3, 4, 9, 10}


def test_edit_distances_against_plain():
    rnd = random.Random(1)
    for _ in range(60):
        item = np.array([rnd.randint(1, 6) for _ in range(rnd.randint(1, 12))], np.int32)
        text = np.array([[rnd.randint(0, 6) for _ in range(15)] for _ in range(3)], np.int32)
        d, end = decontaminate.edit_distances(item, text)
        for k in range(3):
            every = [distance(item.tolist(), text[k, :e].tolist()) for e in range(16)]
            assert d[k] == min(every) == every[end[k]]


# ---- classifier ----------------------------------------------------------------------


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = quality_model.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) > 0.98
    bad = [r for r in got if r.quality == 0]
    assert sum(r.predicted == 0 for r in bad) > 0.9 * len(bad)


def test_lookup_tables_score_as_the_sum_of_parts():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.2)).astype(float)  # only an interaction tells
    model = quality_model.fit(x, y)
    assert np.mean((model.score(x) > 0.5) == y) > 0.85
    assert any({i, j} == {0, 1} for i, j, _ in model.pairs)
    b = model.bins(x[:1])[0]
    total = model.base + sum(t[b[j]] for j, t in enumerate(model.tables))
    total += sum(t[b[i] * 8 // 32, b[j] * 8 // 32] for i, j, t in model.pairs)
    assert model.score(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    assert all(len(c) == 31 for c in model.cuts)
    again = quality_model.fit(x, y)
    assert (again.score(x) == model.score(x)).all()


def test_pairs_of_features_with_few_values():
    """Features of two or five values have cells of their own in the pair tables."""
    rnd = np.random.default_rng(3)
    for values in (2, 5):
        x = np.column_stack([rnd.integers(0, values, 4000), rnd.integers(0, values, 4000), rnd.normal(size=4000)]).astype(float)
        y = ((x[:, 0] >= values / 2) ^ (x[:, 1] >= values / 2)).astype(float)
        model = quality_model.fit(x, y)
        assert np.mean((model.score(x) > 0.5) == y) > 0.98


def test_one_boosting_round_by_brute_force():
    """A tree's first split and a grid's split are the best of all; values are sums of gradients over curvatures."""
    rnd = np.random.default_rng(4)
    gain = lambda g, h: g.sum() ** 2 / (h.sum() + 1.0)
    for _ in range(50):
        g, h = rnd.normal(size=12), rnd.uniform(0.1, 2, 12)
        best = max(range(1, 12), key=lambda k: gain(g[:k], h[:k]) + gain(g[k:], h[k:]))
        tree = quality_model._tree(g, h, 2)
        assert tree[:best] == pytest.approx(g[:best].sum() / (h[:best].sum() + 1)) and tree[best:] == pytest.approx(g[best:].sum() / (h[best:].sum() + 1))
        three = quality_model._tree(g, h, 3)
        assert len(set(three)) == 3 and (three == tree).sum() >= min(best, 12 - best)
        g, h = rnd.normal(size=(6, 6)), rnd.uniform(0.1, 2, (6, 6))
        parts = lambda z, i, j: (z[:i, :j], z[:i, j:], z[i:, :j], z[i:, j:])
        gains = {(i, j): sum(map(gain, parts(g, i, j), parts(h, i, j))) for i in range(1, 6) for j in range(1, 6)}
        (i, j), most = max(gains.items(), key=lambda x: x[1])
        found, value = quality_model._quadrants(g, h)
        assert found == pytest.approx(most)
        for own, a, b in zip(parts(value, i, j), parts(g, i, j), parts(h, i, j), strict=True):
            assert own == pytest.approx(a.sum() / (b.sum() + 1))


def test_scores_are_those_of_the_rows_features(spark, docs):
    """What the query returns is the model on plainly computed features, and repeated doc_ids are fitted once."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    twice = docs.unionByName(docs.where("doc_id % 3 = 0"))
    model, again = quality_model.train(docs, labels), quality_model.train(twice, labels)
    rows = docs.collect()
    plain = dict(zip((r.doc_id for r in rows), model.score(quality_model.features(pa.array([r.text for r in rows]))), strict=True))
    assert {r.doc_id: r.score for r in quality_model.classify(twice, labels).collect()} == pytest.approx(plain)
    assert (again.score(quality_model.features(pa.array(["one two"]))) == model.score(quality_model.features(pa.array(["one two"])))).all()


def test_features_of_long_texts(monkeypatch, docs):
    """A text that is read in pieces has the features that it has beside others."""
    texts = [r.text for r in docs.limit(60).collect()] + ["", "É Ü a", "x" * 9000, "Ab É\n" * 900, None]
    together = quality_model.features(pa.array(texts))
    for name in ("symbolake.llm.textkernel.CHUNK", "symbolake.llm.quality_model.CHUNK"):
        monkeypatch.setattr(name, 1000)
    apart = np.concatenate([quality_model.features(pa.array([t], pa.string())) for t in texts])
    assert (together == apart).all()


def test_classifier_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (7, None, None), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.classify(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    none = labels.where("false")
    assert {r.score for r in quality_model.classify(odd_docs, none).collect()} == {0.5}
    assert quality_model.classify(no_docs, labels).count() == 0
    kept = quality_model.keep_good(odd_docs, none)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


# ---- token files ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return __import__("public_tokenizers").path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1003, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1003 * bits // 8) and (token_files.unpack(data, bits, 1003) == ids).all()


def test_widths():
    assert [token_files.width(n) for n in (1, 2, 3, 256, 257, 49_408, 65_537)] == [1, 1, 2, 8, 9, 16, 17]


@pytest.mark.parametrize("bits", [9, 16])
def test_random_access(tmp_path, bits):
    rnd = np.random.default_rng(1)
    docs = [rnd.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32) for n in (3, 0, 1, 400, 64, 63, 65, 1000)]
    with open(tmp_path / "f", "wb") as out:
        w = token_files.Writer(out, bits, 64)
        for i, d in enumerate(docs):
            w.add(i if i else None, d)
        w.close()
    with pa.OSFile(str(tmp_path / "f")) as source:
        r = token_files.Reader(source)
        whole = np.concatenate(docs)
        assert r.ends.tolist() == np.cumsum([len(d) for d in docs]).tolist() and r.nulls.tolist() == [True] + [False] * 7
        for a, b in ((0, len(whole)), (5, 5), (63, 65), (100, 900), (len(whole) - 1, len(whole))):
            assert (r.ids(a, b) == whole[a:b]).all()


def test_encoding_equals_the_library(tokenizer, docs):
    code = token_files.Encoder(tokenizer)
    odd = ["a<|endoftext|>b c", "  lead  trail ", " x  y", "é ́x", "ΣΑΣ ΌΔΟΣ it's I'LL", "", "\n\n", "a b c", "İstanbul ẞ ǅ", "x.y,z!! a... 3.14 €,5", None, "don't'S 's", "a" * 3000, "1a2b", "q.<|startoftext|>.q"]
    texts = odd + [r.text for r in docs.limit(120).collect()]
    for _ in range(2):
        ids, at = code.encode(*token_files.buffers(pa.array(texts)))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == code.encode_whole(t or ""), t


def test_added_tokens_by_their_spelling(tokenizer):
    texts = ["a <|endoftext|> b", "a <|ENDOFTEXT|> b", "x<|EndOfText|>y x<|endoftext|>y", "<|STARTOFTEXT|><|endoftext|>", "<|startoftext|><|endoftext|>"]
    for order in (texts, texts[::-1]):
        code = token_files.Encoder(tokenizer)
        for batch in (order, *([t] for t in order)):
            ids, at = code.encode(*token_files.buffers(pa.array(batch)))
            assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(batch))] == [code.encode_whole(t) for t in batch]


def test_added_tokens_in_any_mix(tokenizer):
    """Random texts with added tokens whole, in mixed case, cut and glued, in any order: the ids are the library's."""
    rnd = random.Random(8)
    some = ["<|endoftext|>", "<|startoftext|>", "<|end", "oftext|>", "<|", "|>", "<", " ", "\n", ".", "'s", "É", "e\u0301", "ß", "\u3000", "word", "42", "K"]
    code = token_files.Encoder(tokenizer)
    assert code.by_pieces
    for _ in range(60):
        texts = ["".join(rnd.choice((str, str.upper, str.title, str.swapcase))(rnd.choice(some)) for _ in range(rnd.randint(0, 12))) for _ in range(20)]
        ids, at = code.encode(*token_files.buffers(pa.array(texts)))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(20)] == [code.encode_whole(t) for t in texts]


def test_equal_hashes_are_told_apart(tokenizer, monkeypatch):
    """Pieces that share a hash, in one batch or with a piece seen before, still get their own ids."""
    monkeypatch.setattr(token_files, "hashes_at", lambda raw, starts, alphabet: np.ones(len(starts), np.uint64))
    for batches in ([["one", "two two", ""]], [["one"], ["two", "one one"]], [["abc"], ["abd"]]):
        code = token_files.Encoder(tokenizer)
        for texts in batches:
            ids, at = code.encode(*token_files.buffers(pa.array(texts)))
            assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [code.encode_whole(t) for t in texts]


def test_other_tokenizers_take_the_plain_way(tokenizer):
    import public_tokenizers

    code = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not code.by_pieces
    texts = ["Case Matters, case matters", " leading", "", "tab\tand  spaces\n"]
    ids, at = code.encode(*token_files.buffers(pa.array(texts)))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [code.encode_whole(t) for t in texts]
    import json

    made = json.loads(token_files.Encoder(tokenizer).tokenizer.to_str())
    assert token_files.splits(made)
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"model": made["model"] | {"dropout": 0.1}}, {"added_tokens": [made["added_tokens"][0] | {"normalized": True}]}, {"added_tokens": [made["added_tokens"][0] | {"content": "a b"}]}):
        assert not token_files.splits(made | change)


def test_many_rows_of_one_id_fill_several_files(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 2000)
    df = spark.createDataFrame([(None if i % 3 else 7, f"text number {i} " * 5) for i in range(400)], "doc_id long, text string")
    manifest = token_files.write(df, tokenizer, 1)
    assert manifest.count() > 10 and manifest.agg({"n_docs": "max"}).first()[0] < 100
    got = token_files.read(manifest).orderBy("start").collect()
    assert len(got) == 400 and [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x or 0))


def test_token_files_end_to_end(spark, tokenizer, docs, odd_docs, no_docs, tmp_path):
    code = token_files.Encoder(tokenizer)
    for df in (docs, odd_docs):
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
        got = token_files.read(token_files.write(df, tokenizer, 1)).orderBy("start").collect()
        start = 0
        for r, g in zip(rows, got, strict=True):
            ids = np.array([*code.encode_whole(r.text or ""), 1], "<u4")
            assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    assert token_files.read(token_files.write(no_docs, tokenizer, 1)).count() == 0


def test_known_words_are_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN", 10)
    code = token_files.Encoder(tokenizer)
    for text in ("one two three four", "five six seven eight nine", "one two ten eleven twelve thirteen", " ".join(f"w{i}x" for i in range(40))):
        ids, _ = code.encode(*token_files.buffers(pa.array([text])))
        assert ids.tolist() == code.encode_whole(text)

