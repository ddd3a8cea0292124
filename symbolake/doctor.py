"""What this installation can do and what state its files are in; never shows a key."""

from __future__ import annotations

import platform
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

from symbolake.model import LANGUAGES
from symbolake.operators.extract import GRAMMARS, backend, grammar, grammar_package
from symbolake.providers import REGISTRY, keys
from symbolake.sources.documents import inspect_object, snapshot_error

HINT = "pip install tree-sitter tree-sitter-javascript tree-sitter-typescript tree-sitter-go tree-sitter-rust"


def _installed(name: str) -> str:
    try:
        return version(name)
    except PackageNotFoundError:
        return "unknown (not installed)"


def runtime() -> dict:
    return {"symbolake_version": _installed("symbolake"), "python_version": platform.python_version(), "platform": platform.platform(), "spark_version": _installed("pyspark")}


def parsers() -> dict:
    packages: dict[str, list[str]] = {}
    for ext in sorted(GRAMMARS):
        packages.setdefault(grammar_package(ext), []).append(ext)
    grammars = [{"package": p, "extensions": e, "installed": all(grammar(x) is not None for x in e)} for p, e in sorted(packages.items())]
    by = {e: "ast (built-in)" if e == ".py" else backend(e) or "none" for e in sorted(LANGUAGES)}
    return {
        "mode": "auto", "backend_by_extension": by, "treesitter_available": any(g["installed"] for g in grammars),
        "grammars": grammars, "install_hint": None if all(g["installed"] for g in grammars) else HINT,
    }


def providers() -> list[dict]:
    return [
        {"name": p.name, "default_model": p.model, "default_dimensions": p.dim, "requires_api_key": p.variable is not None, "env_var": p.variable, "keys_configured": len(keys(p.variable)) if p.variable else 0}
        for _, p in sorted(REGISTRY.items())
    ]


def _file(path: Path) -> tuple[dict, dict | None]:
    info = {"path": str(path), "exists": path.exists(), "size_bytes": path.stat().st_size if path.exists() else 0, "read_error": None}
    if not path.exists():
        return info, None
    data, info["read_error"] = inspect_object(path)
    return info, data


def snapshot(path: Path) -> dict:
    info, data = _file(path)
    blank = {"schema_version": None, "schema_error": None, "file_count": None, "symbol_count": None}
    if data is None:
        return info | blank
    symbols = sum(map(len, (data.get("symbols") or {}).values()))
    return info | {"schema_version": int(data.get("schema_version") or 0), "schema_error": snapshot_error(data, path), "file_count": len(data.get("files") or {}), "symbol_count": symbols}


def index(path: Path) -> dict:
    info, data = _file(path)
    if data is None:
        return info | {"entry_count": None, "model": None, "dim": None, "key_schema": None, "has_centroid": False}
    known = data.get("key_schema")
    return info | {"entry_count": len(data.get("entries") or {}), "model": data.get("model") or None, "dim": int(data.get("dim") or 0), "key_schema": None if known is None else int(known), "has_centroid": bool(data.get("centroid"))}


def report(snapshot_path: str, index_path: str) -> dict:
    return {"runtime": runtime(), "parsers": parsers(), "providers": providers(), "files": {"codex": snapshot(Path(snapshot_path)), "index": index(Path(index_path))}}


def lines(r: dict):
    """The report for a human reader."""
    yield "symbolake doctor: offline, no network or provider call"
    yield from (f"  {k}: {v}" for k, v in r["runtime"].items())
    yield "parsers"
    yield from (f"  {e}: {b}" for e, b in r["parsers"]["backend_by_extension"].items())
    yield from (f"  {g['package']} ({', '.join(g['extensions'])}): {'installed' if g['installed'] else 'missing'}" for g in r["parsers"]["grammars"])
    yield "providers"
    for p in r["providers"]:
        state = f"{p['env_var']}: {p['keys_configured']} key(s)" if p["requires_api_key"] else "no key needed"
        yield f"  {p['name']}: {p['default_model']} / {p['default_dimensions']}, {state}"
    yield "files"
    for kind, f in r["files"].items():
        state = "missing" if not f["exists"] else f["read_error"] or ", ".join(f"{k} {v}" for k, v in f.items() if k not in ("path", "exists", "read_error"))
        yield f"  {kind} {f['path']}: {state}"
