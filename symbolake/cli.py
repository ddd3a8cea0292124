"""Command line: each command checks its inputs, runs a plan and prints rows or one JSON object."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from symbolake import doctor, envelope
from symbolake.envelope import ERROR, OK, Failure
from symbolake.model import EMBED_BATCH, ENTRIES, GATE_MIN_POPULATION, HIT, SEARCH_K, SIDE, SIMILAR_K, SNAPSHOT_VERSION, TIMEOUT_S, TOP_K
from symbolake.operators import clusters, diff, lookup, vectors
from symbolake.plans import indexing, snapshot
from symbolake.providers import EmbeddingError, Request, Rotation, keys, provider
from symbolake.sources import documents

CAVEAT = "A hint: what is reached only by dynamic dispatch, a decorator, an entry point or getattr looks unused here."
SHOWN = 20


def session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active:
        return active
    spark = SparkSession.builder.master("local[*]").appName("symbolake").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_store(path: str) -> bool:
    """Whether a path names a folder of Parquet versions and no JSON document."""
    return not path.endswith(".json") and not Path(path).is_file()


def read_snapshot(path: str, label: str = "") -> dict:
    """A stored snapshot; a missing one is not an empty one."""
    if not Path(path).exists():
        raise missing(path, label)
    data = documents.load(path, {})
    if error := documents.snapshot_error(data, path):
        raise Failure(error)
    return data


def missing(path: str, label: str = "") -> Failure:
    return Failure(f"Snapshot not found{label}: {path}. Run `symbolake scan` first or give another path; a missing snapshot is not taken for an empty one.")


def open_snapshot(path: str, label: str = "") -> snapshot.Snapshot:
    """A snapshot as tables: of a store they are scanned, of a document they are made on the driver."""
    if not is_store(path):
        return snapshot.from_document(session(), read_snapshot(path, label))
    version = snapshot.newest(session(), path)
    if version is None:
        raise missing(path, label)
    try:
        return snapshot.load(session(), version)
    except ValueError as e:
        raise Failure(str(e)) from e


def read_index(path: str, need_rows: bool = True) -> dict:
    data = documents.load(path, {})
    if need_rows and not data.get("entries"):
        raise Failure(EMPTY, ERROR)
    if error := documents.index_error(data, path):
        raise Failure(error)
    if need_rows and not data.get("centroid"):
        raise Failure("The index has no centroid: run `symbolake embed` to rebuild it.")
    return data


EMPTY = "The index is empty: run `symbolake embed` first."


def open_index(path: str, need_rows: bool = True) -> tuple[indexing.Index, int]:
    """An index and the number of its entries."""
    if not is_store(path):
        data = read_index(path, need_rows)
        return indexing.from_document(session(), data), len(data.get("entries") or {})
    version = snapshot.newest(session(), path)
    index = indexing.load(session(), version) if version else indexing.Index(session().createDataFrame([], ENTRIES))
    n = index.rows.count()
    if need_rows and not n:
        raise Failure(EMPTY, ERROR)
    if error := documents.index_error({"entries": n, "key_schema": index.key_schema}, path):
        raise Failure(error)
    return index, n


def rows(df: DataFrame, *names: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.select(*names).collect()]


def scan(a) -> tuple[dict, list[str]]:
    spark, root = session(), Path(a.root).resolve()
    if is_store(a.out):
        version = snapshot.newest(spark, a.out)
        previous = snapshot.load(spark, version) if version else None
    else:
        before = documents.load(a.out, {})
        previous = snapshot.placed(snapshot.from_document(spark, before)) if before.get("files") else None
    try:
        built = snapshot.build(spark, root, a.ignore, previous, a.parser)
        if is_store(a.out):
            kept = snapshot.load(spark, snapshot.save(built, a.out, a.find_index))
            n = lookup.totals(kept.files, kept.symbols, kept.imports, kept.calls)
        else:
            made = snapshot.export(built)
            documents.save(a.out, made)
            n = {"files": len(made["files"]), "symbols": sum(map(len, made["symbols"].values())), "files_with_imports": len(made["edges"]["imports"]), "calls": len(made["edges"]["calls"])}
        built.release()
    except RuntimeError as e:
        raise Failure(str(e), ERROR) from e
    edges = {"files_with_imports": n["files_with_imports"], "calls": n["calls"]}
    out = {"root": str(root), "out": a.out, "codex_schema_version": SNAPSHOT_VERSION, "files": n["files"], "symbols": n["symbols"], "edges": edges}
    return out, [f"{n['files']} file(s), {n['symbols']} symbol(s) -> {a.out}"]


def _symbols(a):
    return open_snapshot(a.codex)


def _listed(found: list[dict], say) -> list[str]:
    out, section = [], None
    for r in found:
        if r["section"] != section:
            section = r["section"]
            out += ["", f"-- {section}"]
        out.append(say(r))
    return out


def find(a):
    found = rows(snapshot.find(_symbols(a), a.pattern).orderBy("ord"), *HIT[1:])
    text = _listed(found, lambda r: f"  {r['name']}  {r['file']}:{r['line']}  {r['signature']}")
    return {"pattern": a.pattern, "count": len(found), "results": found}, [*text, f"{len(found)} result(s)"]


def section(a):
    found = rows(lookup.section(_symbols(a).symbols, a.name).orderBy("ord"), "name", "file", "line", "signature", "docstring", "language")
    return {"name": a.name, "count": len(found), "rows": found}, [json.dumps(found, indent=2, ensure_ascii=False)]


def deps(a):
    calls = _symbols(a).calls
    order = ("file", "caller", "callee")
    into, out = (rows(f(calls, a.symbol).orderBy(*order), *order, "line") for f in (lookup.callers_of, lookup.callees_of))
    text = [f"-- callers of {a.symbol} ({len(into)})", *(f"  {r['caller']}  {r['file']}:{r['line']}" for r in into), f"-- called by {a.symbol} ({len(out)})", *(f"  {r['callee']}  {r['file']}:{r['line']}" for r in out)]
    if not into and not out:
        text.append("No edges; calls are known for Python files only.")
    return {"symbol": a.symbol, "callers": into, "callees": out, "caller_count": len(into), "callee_count": len(out)}, text


def unused(a):
    s = _symbols(a)
    found = rows(lookup.unused(s.symbols, s.calls).orderBy("file", "line", "ord"), *SIDE)
    return {"count": len(found), "symbols": found, "caveat": CAVEAT}, [*(f"  {r['section']}  {r['name']}  {r['file']}:{r['line']}" for r in found), f"{len(found)} symbol(s) that no call names. {CAVEAT}"]


def diff_(a):
    old, new = (open_snapshot(p, f" ({k})") for k, p in (("old", a.old), ("new", a.new)))
    files, symbols = diff.diff_files(old.files, new.files), diff.diff_symbols(old.symbols, new.symbols)
    counts = diff.summary(files, symbols).first().asDict()
    total = counts.pop("total_changes")
    by_file = {k: [r["file"] for r in files.where(F.col("kind") == f"files_{k}").orderBy("file").collect()] for k in ("added", "removed", "changed")}
    plain = ("key", "section", "name", "file", "line")
    shape = {"added": (*plain, "signature"), "removed": (*plain, "signature"), "moved": (*plain, "old_line", "new_line"), "signature_changed": (*plain, "old_signature", "new_signature")}
    by_symbol = {k: rows(symbols.where(F.col("kind") == f"symbols_{k}").orderBy("section", "file", "name", "line"), *names) for k, names in shape.items()}
    text = [f"{k}: {v}" for k, v in counts.items()] if total else ["No differences."]
    for k, found in [*((f"files {k}", v) for k, v in by_file.items()), *((f"symbols {k}", [f"{r['section']}  {r['name']}  {r['file']}:{r['line']}" for r in v]) for k, v in by_symbol.items())]:
        if found:
            text += ["", f"-- {k} ({len(found)})", *(f"  {x}" for x in found[:SHOWN])]
            text += [f"  and {len(found) - SHOWN} more (use --json for all)"] * (len(found) > SHOWN)
    return {"old": a.old, "new": a.new, "summary": counts, "files": by_file, "symbols": by_symbol}, text


def doctor_(a):
    try:
        r = doctor.report(a.codex, a.index)
    except Exception as e:  # what fails here is the diagnosis itself
        raise Failure(f"the diagnosis failed: {e}", ERROR) from e
    return r, [*doctor.lines(r)]


def _rotation(a, source) -> Rotation:
    found = keys(source.variable)
    if not found:
        raise Failure(f"No API key: set {source.variable} (or {source.variable}S, a comma list that is rotated) for provider {source.name}.")
    return Rotation(source, found)


def embed(a):
    symbols = open_snapshot(a.codex).symbols
    source = provider(a.provider)
    model, dim = a.model or source.model, a.dimensions or source.dim
    rotation = _rotation(a, source)
    stored = is_store(a.index)
    if stored:
        version = snapshot.newest(session(), a.index)
        old = indexing.load(session(), version) if version else indexing.Index(session().createDataFrame([], ENTRIES), model, dim)
    else:
        old = indexing.from_document(session(), documents.load(a.index, {"model": model, "dim": dim, "key_schema": 2}))
    progress = None if a.json else lambda done, n: print(f"  {done}/{n}")
    spread = source if stored and source.variable is None else None
    got = indexing.refresh(symbols, old, rotation.embed, model, dim, a.batch_size, a.timeout, progress, spread)
    if got.discarded:
        print(f"model or size changed ({old.model}/{old.dim} -> {model}/{dim}): {got.discarded} old vector(s) discarded", file=sys.stderr)
    if stored:
        n = indexing.load(session(), indexing.save(got.index, a.index)).rows.count()
    else:
        written = indexing.to_document(got.index)
        documents.save(a.index, written)
        n = len(written["entries"])
    got.release()
    if got.error:
        raise Failure(str(got.error))
    out = {"codex": a.codex, "index": a.index, "provider": source.name, "model": model, "dim": dim, "entries_total": got.total, "entries_indexed": n, "pruned": got.pruned, "migrated": got.migrated}
    return out, [f"{got.embedded} embedded, {got.pruned} pruned, {got.migrated} migrated; {n} in {a.index}"]


def search(a):
    index, n = open_index(a.index)
    source = provider(a.provider)
    rotation = _rotation(a, source)
    try:
        query = rotation.embed(Request((a.question,), "query", a.model or source.model, a.dimensions or source.dim, a.timeout))[0]
    except EmbeddingError as e:
        raise Failure(str(e)) from e
    gated = n >= GATE_MIN_POPULATION
    found = rows(indexing.search(index, query, a.min_score, a.top_k, a.section), *HIT)
    text = [] if gated else [f"{n} entries are too few for the gate"]
    text += _listed(found, lambda r: f"  [{r['score']:.2f}] {r['name']}  {r['file']}:{r['line']}" + (f"  {r['docstring']}" if r["docstring"] else ""))
    return {"question": a.question, "count": len(found), "threshold_applied": gated, "results": found}, [*text, f"{len(found)} result(s)"]


def similar(a):
    index, n = open_index(a.index)
    above = clusters.similar_pairs(index.rows, index.centroid, a.min_score).rows.persist(StorageLevel.DISK_ONLY)
    pairs, counts = vectors.similar(index.rows, index.centroid, a.min_score, a.section, a.exclude_same_file, above)
    same = counts.first()[0]
    found = rows(pairs, "score", "a", "b")
    above.unpersist()
    side = lambda s: f"{s['section']}::{s['name']}  {s['file']}:{s['line']}"
    text = [f"{n} entries, {n * (n - 1) // 2} pair(s), {same} in one file {'left out' if a.exclude_same_file else 'included'}", *(f"  [{r['score']:.2f}] {side(r['a'])}  <->  {side(r['b'])}" for r in found), f"{len(found)} pair(s)"]
    return {"count": len(found), "entries": n, "pairs_considered": n * (n - 1) // 2, "same_file_pairs": same, "excluded_same_file": a.exclude_same_file, "pairs": found}, text


def status(a):
    data = open_snapshot(a.codex)
    index, _ = open_index(a.index, need_rows=False)
    got = indexing.stale(data.symbols, index)
    codex = {"path": a.codex, "resources": data.symbols.count(), "schema_version": data.schema_version}
    held = index.key_schema if is_store(a.index) else int(documents.load(a.index, {}).get("key_schema") or 0)
    out = {"path": a.index, "resources": got["indexed"], "model": index.model, "dim": index.dim, "key_schema": held, "stale": got["stale"]}
    return {"codex": codex, "index": out}, [f"index: {out['resources']}, {index.model or '(none)'} / {index.dim}", f"snapshot: {codex['resources']}, {got['stale']} not indexed"]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="symbolake", description="Source-symbol analytics on Spark.", epilog="exit codes: 0 success (also with no results), 1 runtime failure, 2 something the user must settle")
    top.add_argument("--version", action="version", version=f"symbolake {doctor.runtime()['symbolake_version']}")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name, f, *positional, **options):
        p = sub.add_parser(name)
        p.add_argument("--json", action="store_true")
        for x in positional:
            p.add_argument(x)
        for k, v in options.items():
            kind = {"action": "store_true"} if v is False else {"action": "append", "default": []} if v == [] else {"default": v, **({"type": type(v)} if isinstance(v, (int, float)) else {})}
            p.add_argument(f"--{k.replace('_', '-')}", **kind)
        p.set_defaults(run=f)
        return p

    # Commands, options and their defaults.
    codex, index = {"codex": "codex.json"}, {"index": "semantic_index.json"}
    p = add("scan", scan, "root", out="codex.json", ignore=[], find_index=False)
    p.add_argument("--parser", default="auto", choices=["auto", "regex", "treesitter", "outline"])
    add("find", find, "pattern", **codex)
    add("section", section, "name", **codex)
    add("deps", deps, "symbol", **codex)
    add("unused", unused, **codex)
    add("diff", diff_, "old", "new")
    add("doctor", doctor_, **codex, **index)
    for p in (add("embed", embed, **codex, **index, batch_size=EMBED_BATCH, timeout=TIMEOUT_S), add("search", search, "question", **index, top_k=TOP_K, min_score=SEARCH_K, section=None, timeout=TIMEOUT_S)):
        p.add_argument("--provider", default="gemini", choices=["gemini", "openai", "local"])
        p.add_argument("--model")
        p.add_argument("--dimensions", type=int)
    add("similar", similar, **index, min_score=SIMILAR_K, section=None, exclude_same_file=False)
    add("status", status, **codex, **index)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        payload, text = a.run(a)
    except Failure as e:
        envelope.fail(a.command, str(e), a.json)
        return e.code
    if a.json:
        envelope.show(a.command, True, **payload)
    else:
        print("\n".join(text))
    return OK
