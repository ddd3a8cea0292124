import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from symbolake.llm import fill_middle, periodic_runs, url_filter

# ---- fill in the middle --------------------------------------------------------------


def plain_cut(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, m, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(x), len(m), f"<S>{z}<P>{x}<M>{m}"
    return n, "psm", len(x), len(m), f"<P>{x}<S>{z}<M>{m}"


def odd_texts():
    rnd = random.Random(5)
    bits = ["abc", "Z", "é", "\U0001d4b3", "\n", " ", "1", "<P", "<", ">", "P>", "S>", "<S", "日本", "\x00"]
    made = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(400)]
    return [None, "", "a", "1", "abc", "...", "<P>", "a<S>b", "x<M>", "<P<S", *made]


def test_cuts_against_plain():
    for i, x in enumerate(odd_texts()):
        assert fill_middle.cut(x or "", fill_middle.draws(1, i)) == plain_cut(i, x)


def test_run_code_of_classes():
    runs = fill_middle.Runs("ab1cé!d")
    assert runs.start.tolist() == [0, 2, 3, 4, 6] and runs.before.tolist() == [0, 1, 2, 3, 5, 6] and runs.units == 6
    assert [runs.offset(k) for k in range(8)] == [0, 2, 3, 4, 5, 6, 7, 7]


def test_fill_middle_round_trip(spark, odd_docs, no_docs):
    rows = [(i, x) for i, x in enumerate(odd_texts())] + [(None, "no id"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in fill_middle.digest(docs).collect()), key=repr)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted(((i, *plain_cut(i, x)[:4], sha(plain_cut(i, x)[4]), sha(x or "")) for i, x in rows), key=repr)
    assert got == want and {r[2] for r in got} == {"plain", "psm", "spm"}
    out = fill_middle.transform(odd_docs.withColumn("N", F.lit("other")).withColumn("output", F.lit("old")))
    assert [c for c in out.columns if c.lower() == "n"] == ["n"] and out.count() == odd_docs.count()
    assert out.where(fill_middle.restored(F.col("output"), F.col("form")) != F.coalesce("text", F.lit(""))).count() == 0
    assert fill_middle.digest(no_docs).count() == 0


# ---- periodic runs -------------------------------------------------------------------


def plain_runs(w):
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def periodic_texts(seed, count):
    rnd = random.Random(seed)
    for _ in range(count):
        w = [f"x{rnd.randrange(rnd.choice((1, 2, 3, 10)))}" for _ in range(rnd.randrange(50))]
        for _ in range(rnd.randrange(3)):
            s, p = rnd.randrange(len(w) + 1), rnd.randrange(1, 8)
            for i in range(s, min(len(w), s + rnd.randrange(60))):
                w[i] = w[s + (i - s) % p]
        yield w


@pytest.mark.parametrize("chunk, pairs", [(1 << 17, 1 << 20), (64, 50), (1, 1)])
def test_runs_against_plain(monkeypatch, chunk, pairs):
    monkeypatch.setattr(periodic_runs, "CHUNK", chunk)
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    texts = list(periodic_texts(7, 600 if chunk > 1 else 60))
    for w, (runs, left) in zip(texts, periodic_runs.analysed(pa.array([" ".join(w) for w in texts])), strict=True):
        assert runs == plain_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert left.decode() == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_extensions_against_plain():
    rnd = random.Random(2)
    sizes = [rnd.randrange(1, 30) for _ in range(12)]
    text = np.repeat(np.arange(12), sizes)
    ids = np.array([rnd.randrange(2) for _ in text])
    ext = periodic_runs.Extensions(ids, text)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if text[i] == text[j]]
    want = [next((k for k in range(len(ids)) if j + k >= len(ids) or text[j + k] != text[j] or ids[i + k] != ids[j + k]), 0) for i, j in pairs]
    assert ext(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])).tolist() == want


def test_time_grows_as_the_words():
    """Texts of one word, of one long period, and without a period: no square of the length."""
    for words in (["a"] * 200_000, [f"w{i % 997}" for i in range(200_000)], [f"w{i * i % 99991}" for i in range(200_000)]):
        (runs, left), = periodic_runs.analysed(pa.array([" ".join(words)]))
        assert len(runs) <= 2 and len(left.split()) <= len(words)


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_runs_of_documents(spark, odd_docs, no_docs):
    rows = [(i, " \t".join(w)) for i, w in enumerate(periodic_texts(9, 300))] + [(None, "a a a a a a a"), (None, None), (3, ""), (5, " \x0b\n"), (5, "x\u00a0y " * 9), (5, "x\u00a0y " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in periodic_runs.digest(periodic_runs.planted(docs)).collect()), key=repr)
    assert got == sorted((plain_row(i, x) for i, x in rows), key=repr)
    clash = odd_docs.withColumn("Runs", F.lit(1)).withColumn("collapsed", F.lit("x"))
    out = periodic_runs.detect(clash)
    assert out.count() == odd_docs.count() and dict(out.dtypes)["collapsed"] == "string" and "Runs" not in out.columns
    assert periodic_runs.digest(periodic_runs.planted(odd_docs)).count() == odd_docs.count()
    assert periodic_runs.digest(periodic_runs.planted(no_docs)).count() == 0


# ---- url filters ---------------------------------------------------------------------

URLS = [
    (None, "", ""), ("", "", ""), ("no scheme/at all", "", ""), ("http://", "", ""), ("HTTP://A.Com", "a.com", ""), ("x://h?q=/a", "h", ""), ("x://h#f/a", "h", ""),
    ("https://User@B.net:80/P/q.html?x=1#y", "user@b.net:80", "/P/q.html"), ("a://b://c/d", "b:", "//c/d"), ("://h/p", "h", "/p"), ("http://É.com/é?", "É.com", "/é"), ("http:///p", "", "/p"),
]


def plain_rule(host, path, rules):
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else None


def test_host_path_and_given_rules(spark):
    hosts = ["com", "example.com", "www.example.com", "aexample.com", "a.www.example.com", "example.com.", "net", "b.net", "notnet", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/1", "/fr/", "/EN/"]
    urls = [*((u, h, p) for u, h, p in URLS), *((f"http://{h}{p}", h, p) for h in hosts for p in paths)]
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)], "page_id long, url string")
    none = spark.createDataFrame([], "url string, bad boolean")
    for rules in (url_filter.RULES, [*url_filter.RULES, ("block", "com", "/"), ("allow", "b.net", "")], []):
        got = {r.page_id: r for r in url_filter.judge(pages, none, rules).collect()}
        for i, (_, host, path) in enumerate(urls):
            want = plain_rule(host, path, rules)
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, want and want[0], want[1] if want else "allow")
    with pytest.raises(ValueError, match="needs a host"):
        url_filter.given_rule(F.lit(""), F.lit(""), [("block", "", "/")])


def plain_mined(rows, least):
    """All rules among sets of at most MAX_TOKENS tokens that have no rule one token smaller inside, by listing subsets."""
    sets = [(frozenset(t), bad) for t, bad in rows]
    counts = {}
    for t, bad in sets:
        for x in t:
            a, b = counts.get(x, (0, 0))
            counts[x] = a + 1, b + bad
    frequent = {x for x, (_, b) in counts.items() if b >= least}
    order = lambda x: (-(1_000_000 * counts[x][1] // counts[x][0]), -counts[x][1], x)
    seen = {}
    for t, bad in sets:
        own = sorted(t & frequent, key=order)[: url_filter.MAX_TOKENS]
        for k in range(1, len(own) + 1):
            for s in itertools.combinations(sorted(own), k):
                a, b = seen.get(s, (0, 0))
                seen[s] = a + 1, b + bad
    rules = {s: n for s, n in seen.items() if n[1] >= least and 100 * n[1] >= url_filter.MIN_CONFIDENCE * n[0]}
    return {s: n for s, n in rules.items() if not any((*s[:i], *s[i + 1 :]) in rules for i in range(len(s)))}


def url_rows(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        site = rnd.choice(["casino-win.example.com", "news.example.org", "m.shop.example.net", "a.b.c.d.example.com"])
        url = f"http{rnd.choice(['', 's'])}://{site}/{rnd.choice(['en', 'de'])}/{rnd.choice(['x', 'y'])}{rnd.randrange(99)}{rnd.choice(['', '.html', '.php'])}{rnd.choice(['', '?ref=1', '?page=2&utm=x'])}"
        bad = "casino" in url or ("news" in url and "ref=" in url) or (".php" in url and "/de/" in url)
        yield url, bad if rnd.random() < 0.93 else not bad


def test_mined_rules_against_all_subsets(spark):
    rows = list(url_rows(3, 900)) + [("http://casino-win.example.com/", None), (None, True), ("nothing", True)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    got = {tuple(r["items"]): (r.n_all, r.n_bad) for r in url_filter.mine(labelled).collect()}
    tokens = {r.url: r.t for r in labelled.select("url", url_filter.tokens(F.col("url")).alias("t")).collect()}
    assert got == plain_mined([(tokens[u], bad) for u, bad in rows if bad is not None], url_filter.MIN_BAD)
    assert any(any("casino" in x for x in items) for items in got) and any(len(items) > 1 for items in got)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)] + [(None, rows[0][0]), (0, rows[0][0])], "page_id long, url string")
    judged = url_filter.judge(pages, labelled, [])
    block = {u for u, t in tokens.items() if any(set(items) <= set(t) for items in got)}
    assert {(r.page_id, r.verdict) for r in judged.collect()} == {(r.page_id, "block" if r.url in block else "allow") for r in pages.collect()}
    assert judged.count() == len(rows) + 2
    # given rules go before mined ones
    assert {r.verdict for r in url_filter.judge(pages.where("url LIKE '%casino%'"), labelled, [("allow", "example.com", "")]).collect()} == {"allow"}


def test_key_is_the_rarest_token(spark):
    labelled = spark.createDataFrame(list(url_rows(3, 900)), "url string, bad boolean")
    tokens = labelled.select(F.explode(url_filter.tokens(F.col("url"))).alias("t"))
    counts = {r.t: r["count"] for r in tokens.groupBy("t").count().collect()}
    for r in url_filter.mine(labelled).collect():
        assert r.key == min(r["items"], key=lambda x: (counts[x], x))


def test_rules_of_all_tokens(spark):
    """Twelve tokens of a higher bad share, in too many good urls for a rule, do not hide two that make a url bad."""
    both, one = "&".join(["pay=1", "now=1"]), ["pay=1", "now=1"]
    part = "&".join(f"k{i}=1" for i in range(12))
    rows = [(f"a://h{i}/?{part}&{both}", True) for i in range(12)] + [(f"a://h{i}/?{part}", False) for i in range(9)]
    rows += [(f"a://g{i}/?{one[i % 2]}", i < 8) for i in range(80)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    got = {tuple(r["items"]): (r.n_all, r.n_bad) for r in url_filter.mine(labelled).collect()}
    assert got == {s: (12, 12) for s in [("query:now", "query:pay"), *((f"query:k{i}", x) for i in range(12) for x in ("query:now", "query:pay"))]}
    pages = spark.createDataFrame([(0, "b://x/?now=2&pay=3"), (1, "b://x/?now=2"), (2, rows[12][0]), (3, rows[0][0])], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, labelled, []).collect()} == {0: "block", 1: "allow", 2: "allow", 3: "block"}


def test_common_parts_are_not_listed(spark):
    """Parts of 60 tokens have 2**60 subsets, and rules of two parts 3600 ways to write them; a url with one token of each part is met."""
    a, b = ("&".join(f"{x}{i}=" for i in range(60)) for x in "ab")
    rows = [(f"s://h/?{a}&{b}", True)] * 15 + [(f"s://h/?{x}", bad) for x in (a, b) for bad in [True] * 2 + [False] * 20]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    (rule,) = url_filter.class_rules(labelled).collect()
    assert sorted(len(x.members) for x in rule.any_of) == [60, 60] and (rule.n_all, rule.n_bad) == (15, 15)
    pages = spark.createDataFrame([(0, "t://x/?a7&b59"), (1, "t://x/?a7&a8"), (2, "t://x/?b1"), (3, rows[0][0])], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, labelled, []).collect()} == {0: "block", 1: "allow", 2: "allow", 3: "block"}
    assert url_filter.mine(labelled).count() == 3600


@pytest.mark.parametrize("seed", range(3))
def test_random_rules_against_all_subsets(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(400):
        names = [x for x in "abcdefghijklmn" if rnd.random() < 0.7]
        bad = ("a" in names and "b" not in names) or ({"c", "d", "m", "n"} <= set(names))
        rows.append((f"s://h/?{'&'.join(names)}", bad if rnd.random() < 0.85 else not bad))
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    tokens = {r.url: r.t for r in labelled.select("url", url_filter.tokens(F.col("url")).alias("t")).collect()}
    sets, counts = [(sorted(tokens[u]), bad) for u, bad in rows], {}
    for t, bad in sets:
        for k in range(1, len(t) + 1):
            for s in itertools.combinations(t, k):
                x = counts.setdefault(s, [0, 0])
                x[0], x[1] = x[0] + 1, x[1] + bad
    rules = {s: (a, b) for s, (a, b) in counts.items() if b >= url_filter.MIN_BAD and 100 * b >= url_filter.MIN_CONFIDENCE * a}
    want = {s: n for s, n in rules.items() if not any((*s[:i], *s[i + 1 :]) in rules for i in range(len(s)))}
    assert want and {tuple(r["items"]): (r.n_all, r.n_bad) for r in url_filter.mine(labelled).collect()} == want


def test_url_filter_with_shuffled_lookups(spark, monkeypatch):
    rows = list(url_rows(4, 500))
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    pages = spark.createDataFrame([(i, u, None) for i, (u, _) in enumerate(rows)], "page_id long, url string, hit_ string")
    want = sorted(map(tuple, url_filter.judge(pages, labelled, url_filter.RULES).collect()))
    monkeypatch.setattr("symbolake.llm.base.BROADCAST_BYTES", 0)
    assert sorted(map(tuple, url_filter.judge(pages, labelled, url_filter.RULES).collect())) == want


def test_url_filter_odd(spark):
    kind = "page_id long, url string, html string, host string, path string, verdict string, token_ string, bad boolean"
    long = "http://" + ".".join(["a"] * 5000) + "/" + "/".join(["d"] * 5000) + "?" + "&".join(f"k{i}" for i in range(5000))
    urls = [long, None, "", "http://x.net/es/1", "http://x.net/es/1"]
    pages = spark.createDataFrame([(i, u, *[None] * 6) for i, u in enumerate(urls)], kind)
    labels = spark.createDataFrame([(1, 0, None), (1, 1, 0), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    labelled = url_filter.labelled_urls(pages, labels)
    assert [tuple(r) for r in labelled.collect()] == [("http://x.net/es/1", True)] * 2
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, labelled, url_filter.RULES).collect()}
    assert got == {0: (None, "allow"), 1: (None, "allow"), 2: (None, "allow"), 3: ("net/es/", "block"), 4: ("net/es/", "block")}
    assert url_filter.judge(pages.limit(0), labelled, url_filter.RULES).count() == 0
    assert url_filter.judge(pages.where("false"), labelled.where("false"), []).count() == 0
