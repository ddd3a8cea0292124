import json

import pytest

from symbolake import cli, providers
from symbolake.plans import indexing, snapshot
from symbolake.providers import EmbeddingError, InvalidKey, QuotaExhausted, Request, Response, Rotation
from symbolake.streaming import CHANGES, change_counts, current, refresh_symbols


@pytest.fixture
def tree(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "__init__.py").write_text("")
    (src / "m.py").write_text("import os\ndef add(a, b):\n    '''Sum.'''\n    return helper(a)\n\ndef helper(x):\n    return x\n\ndef orphan(): pass\n")
    (src / "w.js").write_text("function draw() {}\nclass Box {}\n")
    return tmp_path


def run(capsys, *args):
    code = cli.main([*map(str, args), "--json"])
    out = capsys.readouterr().out
    assert out.isascii()
    data = json.loads(out)
    assert list(data)[:3] == ["command", "schema_version", "ok"] and data["schema_version"] == 1
    return code, data


def scan(capsys, tree, out="c.json", *more):
    return run(capsys, "scan", tree / "src", "--out", tree / out, *more)


def test_scan_and_lookups(spark, capsys, tree):
    code, got = scan(capsys, tree)
    assert code == 0 and (got["files"], got["symbols"], got["edges"]) == (3, 5, {"files_with_imports": 1, "calls": 1})
    c = ("--codex", tree / "c.json")
    _, got = run(capsys, "find", "SUM", *c)
    assert got["count"] == 1 and got["results"][0] == {"section": "python_functions", "name": "add", "file": "m.py", "line": 2, "signature": "def add(a, b)", "docstring": "Sum."}
    _, got = run(capsys, "section", "generic_classes", *c)
    assert [r["name"] for r in got["rows"]] == ["Box"] and "section" not in got["rows"][0]
    _, got = run(capsys, "deps", "helper", *c)
    assert (got["caller_count"], got["callee_count"]) == (1, 0) and got["callers"][0]["caller"] == "add"
    _, got = run(capsys, "unused", *c)
    assert [s["name"] for s in got["symbols"]] == ["add", "orphan"] and got["caveat"]
    assert run(capsys, "section", "none", *c)[0] == 0
    assert cli.main(["find", "add", "--codex", str(tree / "c.json")]) == 0 and "1 result" in capsys.readouterr().out


def test_scans_are_bytes_for_bytes_equal(spark, capsys, tree):
    scan(capsys, tree)
    first = (tree / "c.json").read_bytes()
    scan(capsys, tree)
    assert (tree / "c.json").read_bytes() == first
    (tree / "src" / "a.go").write_text("func G() {}\n")
    (tree / "src" / "m.py").write_text("class Z:\n    def q(self): pass\n")
    scan(capsys, tree)
    scan(capsys, tree, "cold.json")
    assert (tree / "c.json").read_bytes() == (tree / "cold.json").read_bytes()


def test_unchanged_files_are_not_parsed_again(spark, capsys, tree, monkeypatch):
    scan(capsys, tree)
    data = json.loads((tree / "c.json").read_text())
    data["symbols"]["python_functions"][0]["docstring"] = "from the cache"
    (tree / "c.json").write_text(json.dumps(data))
    scan(capsys, tree)
    assert "from the cache" in (tree / "c.json").read_text()
    scan(capsys, tree, "c.json", "--parser", "regex")
    assert "from the cache" not in (tree / "c.json").read_text()


def test_diff_and_guards(spark, capsys, tree):
    scan(capsys, tree)
    (tree / "src" / "m.py").write_text("\ndef add(a):\n    return 1\n")
    scan(capsys, tree, "new.json")
    code, got = run(capsys, "diff", tree / "c.json", tree / "new.json")
    assert code == 0 and got["summary"] == {"files_added": 0, "files_removed": 0, "files_changed": 1, "symbols_added": 0, "symbols_removed": 2, "symbols_moved": 1 if got["symbols"]["moved"] else 0, "symbols_signature_changed": 1}
    assert set(got["symbols"]["signature_changed"][0]) == {"key", "section", "name", "file", "line", "old_signature", "new_signature"}
    assert run(capsys, "diff", tree / "none.json", tree / "c.json")[0] == 2
    for version, word in ((None, "scan"), (9, "newer")):
        data = json.loads((tree / "c.json").read_text()) | {"schema_version": version}
        (tree / "odd.json").write_text(json.dumps(data))
        code, got = run(capsys, "find", "x", "--codex", tree / "odd.json")
        assert code == 2 and not got["ok"] and word in got["error"]
    (tree / "bad.json").write_text("{")
    assert run(capsys, "find", "x", "--codex", tree / "bad.json")[0] == 2
    assert cli.main(["find", "x", "--codex", "none"]) == 2 and "not found" in capsys.readouterr().err
    assert scan(capsys, tree, "t.json", "--parser", "treesitter")[0] == 1


class Fake:
    name, model, dim, variable = "fake", "m", 3, "FAKE_API_KEY"

    def __init__(self, fail=()):
        self.fail, self.calls = dict(fail), []

    def embed(self, request, key, **_):
        self.calls.append((key, len(request.texts)))
        if (len(self.calls), key) in self.fail:
            raise self.fail[len(self.calls), key]
        return [providers.unit([len(t), t.count("a") + 1, 1]) for t in request.texts]


def test_index_life_cycle(spark, capsys, tree, monkeypatch):
    fake = Fake()
    monkeypatch.setitem(providers.REGISTRY, "local", fake)
    monkeypatch.setenv("FAKE_API_KEY", "secret-1")
    scan(capsys, tree)
    files = ("--codex", tree / "c.json", "--index", tree / "i.json")
    code, got = run(capsys, "embed", *files, "--provider", "local", "--batch-size", 2)
    assert code == 0 and (got["entries_total"], got["entries_indexed"], got["pruned"], got["migrated"]) == (5, 5, 0, 0) and [n for _, n in fake.calls] == [2, 2, 1]
    first = (tree / "i.json").read_bytes()
    run(capsys, "embed", *files, "--provider", "local")
    assert len(fake.calls) == 3 and (tree / "i.json").read_bytes() == first
    code, got = run(capsys, "status", *files)
    assert got["codex"]["resources"] == 5 and got["index"] == {"path": str(tree / "i.json"), "resources": 5, "model": "m", "dim": 3, "key_schema": 2, "stale": 0}
    code, got = run(capsys, "search", "a question", "--index", tree / "i.json", "--provider", "local", "--min-score", -9, "--top-k", 3)
    assert code == 0 and got["threshold_applied"] and got["count"] == 3 and set(got["results"][0]) == {"score", "section", "name", "file", "line", "signature", "docstring"}
    code, got = run(capsys, "similar", "--index", tree / "i.json", "--min-score", -9)
    assert (got["entries"], got["pairs_considered"], got["count"]) == (5, 10, 10) and set(got["pairs"][0]["a"]) == {"section", "name", "file", "line"}
    # a removed and a changed symbol
    (tree / "src" / "w.js").write_text("class Box {}\n")
    scan(capsys, tree)
    _, got = run(capsys, "status", *files)
    assert got["index"]["stale"] == 1
    _, got = run(capsys, "embed", *files, "--provider", "local")
    assert (got["pruned"], got["entries_indexed"]) == (2, 4)
    # keys of another schema are made again without a call
    data = json.loads((tree / "i.json").read_text())
    data |= {"key_schema": 1, "entries": {f"old{i}": e for i, e in enumerate(data["entries"].values())}}
    (tree / "i.json").write_text(json.dumps(data))
    assert run(capsys, "similar", "--index", tree / "i.json")[0] == 2
    n = len(fake.calls)
    _, got = run(capsys, "embed", *files, "--provider", "local")
    assert got["migrated"] == 4 and len(fake.calls) == n
    # another model starts anew
    _, got = run(capsys, "embed", *files, "--provider", "local", "--model", "other")
    assert len(fake.calls) > n and json.loads((tree / "i.json").read_text())["model"] == "other"


def test_error_keeps_what_was_done(spark, capsys, tree, monkeypatch):
    fake = Fake({(2, "k"): EmbeddingError("down")})
    monkeypatch.setitem(providers.REGISTRY, "local", fake)
    monkeypatch.setenv("FAKE_API_KEYS", " k , ")
    scan(capsys, tree)
    code, got = run(capsys, "embed", "--codex", tree / "c.json", "--index", tree / "i.json", "--provider", "local", "--batch-size", 2)
    data = json.loads((tree / "i.json").read_text())
    assert code == 2 and got["error"] == "down" and len(data["entries"]) == 2 and len(data["centroid"]) == 3


def test_embed_guards(spark, capsys, tree, monkeypatch):
    for v in ("GEMINI_API_KEY", "GEMINI_API_KEYS"):
        monkeypatch.delenv(v, raising=False)
    index = tree / "i.json"
    assert run(capsys, "embed", "--codex", tree / "none", "--index", index)[0] == 2 and not index.exists()
    scan(capsys, tree)
    code, got = run(capsys, "embed", "--codex", tree / "c.json", "--index", index)
    assert code == 2 and "GEMINI_API_KEY" in got["error"]
    assert run(capsys, "search", "q", "--index", index)[0] == 1 and run(capsys, "similar", "--index", index)[0] == 1
    index.write_text(json.dumps({"key_schema": 2, "entries": {"a": {"vector": [1.0]}}}))
    assert run(capsys, "similar", "--index", index)[0] == 2


def test_rotation():
    said = []
    source = Fake({(1, "a"): QuotaExhausted("q"), (4, "b"): QuotaExhausted("q")})
    r = Rotation(source, ["a", "b", "c"], said.append)
    q = Request(("x",), "document", "m", 3)
    for _ in range(3):
        r.embed(q)
    assert [k for k, _ in source.calls] == ["a", "b", "b", "b", "c"] and len(said) == 2 and not any(k in s.split() for s in said for k in ("a", "b", "c"))
    with pytest.raises(InvalidKey):
        Rotation(Fake({(1, "a"): InvalidKey("no")}), ["a", "b"]).embed(q)
    with pytest.raises(QuotaExhausted):
        Rotation(Fake({(1, "a"): QuotaExhausted("q")}), ["a"]).embed(q)


@pytest.mark.parametrize("name", ["gemini", "openai"])
def test_services(name):
    source, seen = providers.provider(name), []
    body = {"gemini": {"embeddings": [{"values": [3, 4]}, {"values": [0, 0]}]}, "openai": {"data": [{"embedding": [3, 4]}, {"embedding": [0, 0]}]}}[name]

    def answer(code, text):
        def post(*args):
            seen.append(args)
            return Response(code, text)

        return post

    q = Request(("a", "b"), "query", source.model, source.dim)
    assert source.embed(q, "KEY", answer(200, json.dumps(body))) == [[0.6, 0.8], [0, 0]]
    url, headers, sent, timeout = seen[0]
    assert "KEY" not in url and "KEY" in str(headers) and timeout == 60.0
    assert name == "openai" or sent["requests"][0]["taskType"] == "RETRIEVAL_QUERY"
    for code, kind in ((429, QuotaExhausted), (401, InvalidKey), (400, InvalidKey), (500, EmbeddingError)):
        with pytest.raises(kind):
            source.embed(q, "KEY", answer(code, '{"error": {"message": "said"}}'))
    with pytest.raises(EmbeddingError) as e:
        source.embed(q, "KEY", answer(500, "x" * 999))
    assert len(str(e.value)) < 400


def test_local_provider(spark):
    local = providers.Local(lambda model, texts: [[3.0, 4.0] for _ in texts])
    assert local.embed(Request(("a",), "document", "m", 2)) == [[0.6, 0.8]]
    with pytest.raises(EmbeddingError, match="fastembed"):
        providers.Local().embed(Request(("a",), "document", "m", 2))
    with pytest.raises(ValueError, match="gemini, local, openai"):
        providers.provider("x")
    df = spark.createDataFrame([(f"k{i}", "t") for i in range(7)], "key string, text string")
    assert {tuple(r.vector) for r in providers.embed_table(df, local, "m", 2).collect()} == {(0.6, 0.8)}


def test_doctor_shows_no_key(capsys, tree, monkeypatch):
    monkeypatch.setenv("OPENAI_API_KEYS", "very-secret-1,very-secret-2")
    (tree / "bad.json").write_text("[1]")
    code, got = run(capsys, "doctor", "--codex", tree / "bad.json", "--index", tree / "none.json")
    assert code == 0 and "very-secret" not in json.dumps(got)
    assert [p["keys_configured"] for p in got["providers"] if p["name"] == "openai"] == [2]
    assert got["files"]["codex"]["read_error"].startswith("holds a JSON list") and not got["files"]["index"]["exists"]
    assert got["parsers"]["backend_by_extension"][".py"] == "ast (built-in)"
    assert cli.main(["doctor", "--codex", str(tree / "bad.json")]) == 0 and "very-secret" not in capsys.readouterr().out


def test_parquet_store(spark, tree, tmp_path):
    built = snapshot.build(spark, tree / "src")
    path = snapshot.save(built, str(tmp_path / "store"))
    again = snapshot.load(spark, path)
    assert snapshot.export(again) == snapshot.export(built)
    again.register("s_")
    assert spark.sql("select count(*) from s_symbols where section = 'python_functions'").first()[0] == 3
    plan = again.symbols.where("section = 'generic_classes'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(section" in plan


def test_commands_on_parquet_stores(spark, capsys, tree, monkeypatch):
    """Snapshot and index as folders of Parquet versions: the same answers, scans that push filters down, no vectors on the driver."""
    scan(capsys, tree)
    store, index = str(tree / "store"), str(tree / "index")
    code, got = run(capsys, "scan", tree / "src", "--out", store)
    assert code == 0 and (got["files"], got["symbols"], got["edges"]) == (3, 5, {"files_with_imports": 1, "calls": 1})
    for args in (("find", "SUM"), ("section", "generic_classes"), ("deps", "helper"), ("unused",)):
        (_, a), (_, b) = run(capsys, *args, "--codex", store), run(capsys, *args, "--codex", tree / "c.json")
        assert a == b
    first = snapshot.newest(spark, store)
    (tree / "src" / "w.js").write_text("class Box {}\n")
    run(capsys, "scan", tree / "src", "--out", store)
    assert snapshot.newest(spark, store) != first and snapshot.export(cli.open_snapshot(store)) == snapshot.export(snapshot.build(spark, tree / "src"))
    assert run(capsys, "diff", tree / "c.json", store)[1]["summary"]["symbols_removed"] == 1
    plan = cli.lookup.section(cli.open_snapshot(store).symbols, "generic_classes")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(section" in plan
    local = providers.Local(lambda model, texts: [[len(t), t.count("a") + 1, 1.0] for t in texts])
    monkeypatch.setitem(providers.REGISTRY, "local", local)
    files = ("--codex", store, "--index", index)
    assert run(capsys, "search", "q", "--index", index, "--provider", "local")[0] == 1 and run(capsys, "status", *files)[1]["index"]["stale"] == 4
    code, got = run(capsys, "embed", *files, "--provider", "local", "--dimensions", 3)
    assert code == 0 and (got["entries_total"], got["entries_indexed"]) == (4, 4)
    assert run(capsys, "status", *files)[1]["index"] == {"path": index, "resources": 4, "model": local.model, "dim": 3, "key_schema": 2, "stale": 0}
    run(capsys, "embed", "--codex", store, "--index", tree / "i.json", "--provider", "local", "--dimensions", 3)
    for args in (("similar", "--min-score", -9), ("search", "a question", "--provider", "local", "--min-score", -9)):
        (_, a), (_, b) = run(capsys, *args, "--index", index), run(capsys, *args, "--index", tree / "i.json")
        assert a["count"] == b["count"] > 0 and [*a] == [*b]
    (tree / "src" / "n.go").write_text("func New() {}\n")
    run(capsys, "scan", tree / "src", "--out", store)
    assert run(capsys, "embed", *files, "--provider", "local", "--dimensions", 3)[1]["entries_indexed"] == 5
    assert not any("entries" in str(r) for r in spark._jsc.getPersistentRDDs().values())
    assert run(capsys, "find", "x", "--codex", tree / "nothing")[0] == 2


def test_round_trip_of_an_index(spark):
    doc = {"model": "m", "dim": 2, "key_schema": 2, "centroid": [0.5, 0.5], "entries": {"b": {"section": "s", "name": "n", "file": "f", "line": 1, "signature": "", "docstring": "", "hash": "h", "vector": [1.0, 0.0]}, "a": {}}}
    back = indexing.to_document(indexing.from_document(spark, doc))
    assert [*back["entries"]] == ["b", "a"] and back["entries"]["b"] == doc["entries"]["b"]


def test_stream_of_changes(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(0, "a.py", ".py", bytearray(b"def one(): pass"), at(1)), (1, "a.py", ".py", bytearray(b"def two(): pass"), at(2)), (2, "b.go", ".go", bytearray(b"func G() {}"), at(3))]
    spark.createDataFrame(rows, CHANGES).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHANGES).parquet(str(tmp_path / "in"))
    refresh_symbols(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([(3, "a.py", ".py", bytearray(b"class Three: pass"), at(9))], CHANGES).write.mode("append").parquet(str(tmp_path / "in"))
    refresh_symbols(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.name for r in current(spark.read.parquet(str(tmp_path / "out"))).collect()) == ["G", "Three"]
    q = change_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(versions) from counts").first()[0] == 4
