from symbolake.model import CALLS, FILES, SYMBOLS
from symbolake.operators import diff, lookup


def symbols(spark, *rows):
    full = [(*r, *[""] * (7 - len(r)), i) if len(r) == 7 else (r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else "", r[5] if len(r) > 5 else "", "python", i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SYMBOLS)


def test_find_section(spark):
    s = symbols(spark, ("f", "Cancel", "a.py", 1, "def job", "Stops İt."), ("f", "x", "b.py", 2, "sig", ""), ("g", "job_cancel", "c.py", 3), (None, None, None, None, None, None))
    names = lambda p: [r.name for r in lookup.find(s, p).orderBy("ord").collect()]
    assert names("CANCEL") == ["Cancel", "job_cancel"] and names("cancel def") == ["Cancel"] and names("job  c.py") == [] and names("cancel   c") == ["job_cancel"]
    assert len(names("")) == 4 and names("python") == []
    assert lookup.section(s, "f").count() == 2 and lookup.section(s, "none").count() == 0


def test_edges(spark):
    c = spark.createDataFrame([("a", "C.m", "go", 1), ("a", "D.m", "run", 2), ("b", "m", "m", 3), ("b", "<module>", "main", 4)], CALLS)
    pairs = lambda df: sorted((r.caller, r.callee) for r in df.collect())
    assert pairs(lookup.callers_of(c, "X.go")) == [("C.m", "go")] and pairs(lookup.callers_of(c, "m")) == [("m", "m")]
    assert pairs(lookup.callees_of(c, "Z.m")) == [("C.m", "go"), ("D.m", "run"), ("m", "m")]


def test_unused(spark):
    s = symbols(spark, *[("f", n, "a.py", i) for i, n in enumerate(["used", "K.used2", "K.__init__", "test_x", "K.test_y", "main", "orphan", "__half", "K.main"])])
    other = s.limit(1).selectExpr("section", "'rusty' as name", "file", "line", "signature", "docstring", "'rust' as language", "ord")
    calls = spark.createDataFrame([("a", "x", "used", 1), ("a", "x", "used2", 1)], CALLS)
    got = lookup.unused(s.unionByName(other), calls)
    assert sorted(r.name for r in got.collect()) == ["__half", "orphan"] and got.columns == s.columns
    assert lookup.unused(s, calls.where("false")).count() == 4


def test_file_changes(spark):
    f = lambda **k: spark.createDataFrame([(n, h, i) for i, (n, h) in enumerate(k.items())], FILES)
    got = diff.diff_files(f(a="1", b="1", c="1"), f(b="2", c="1", d="1"))
    assert sorted((r.kind, r.file) for r in got.collect()) == [("files_added", "d"), ("files_changed", "b"), ("files_removed", "a")]


def test_symbol_changes(spark):
    old = symbols(spark, ("f", "foo", "m.py", 1, "def foo()"), ("f", "bar", "m.py", 10, "def bar()"), ("f", "twin", "m.py", 5, "a"), ("f", "twin", "m.py", 9, "b"))
    new = symbols(spark, ("f", "foo", "m.py", 4, "def foo(x)"), ("f", "twin", "m.py", 5, "a"), ("f", "twin", "m.py", 12, "b"), ("f", "twin", "m.py", 20, "c"), ("g", "bar", "m.py", 10, "def bar()"))
    got = diff.diff_symbols(old, new)
    assert sorted((r.kind, r.key, r.line, r.old_line, r.new_line, r.old_signature, r.new_signature) for r in got.collect() if r.kind in ("symbols_moved", "symbols_signature_changed")) == [
        ("symbols_moved", "f::foo::m.py", 4, 1, 4, "def foo()", "def foo(x)"),
        ("symbols_moved", "f::twin::m.py", 12, 9, 12, "b", "b"),
        ("symbols_signature_changed", "f::foo::m.py", 4, 1, 4, "def foo()", "def foo(x)"),
    ]
    assert sorted((r.kind, r.key, r.line) for r in got.collect() if r.kind in ("symbols_added", "symbols_removed")) == [("symbols_added", "f::twin::m.py", 20), ("symbols_added", "g::bar::m.py", 10), ("symbols_removed", "f::bar::m.py", 10)]
    same = diff.summary(diff.diff_symbols(old, old)).first().asDict()
    assert same == {**dict.fromkeys(diff.KINDS, 0), "total_changes": 0}
    assert diff.summary(got).first().total_changes == 6
