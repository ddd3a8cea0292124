"""Schemas and fixed names of the symbol tables."""

from __future__ import annotations

# Section, language and version names that stored files share.
SECTIONS = ("python_functions", "python_methods", "python_classes", "generic_functions", "generic_classes", "generic_methods")
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust"}
SNAPSHOT_VERSION = 1
KEY_VERSION = 2
ENVELOPE_VERSION = 1

EDGE_LANGUAGE = "python"
MODULE_CALLER = "<module>"

FILES = "file string, sha256 string, ord long"
SYMBOLS = "section string, name string, file string, line int, signature string, docstring string, language string, ord long"
IMPORTS = "file string, module string"
CALLS = "file string, caller string, callee string, line int"
ENTRIES = "key string, section string, name string, file string, line int, signature string, docstring string, hash string, vector array<double>, ord long"
SIDE = ("section", "name", "file", "line")
HIT = ("score", "section", "name", "file", "line", "signature", "docstring")

# Gate defaults.
GATE_MIN_POPULATION = 5
SEARCH_K, SIMILAR_K, TOP_K, EMBED_BATCH, TIMEOUT_S = 1.0, 2.0, 8, 50, 60.0
