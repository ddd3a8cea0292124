"""Parsers as table functions for SQL text: ``FROM files f, LATERAL python_symbols(f.content) s``.

Contents may be binary or strings; null, bytes that are no UTF-8, and what does not
parse give no rows. A row goes to Python at a time, so rows travel pickled in batches
and not as Arrow tables of one row each. SQL parses files where its table lies:
``extract.spread`` deals a small one to all cores.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from symbolake.operators import extract
from symbolake.operators.outline import outline


def _source(content) -> str | None:
    if isinstance(content, str):
        return content.replace("\r\n", "\n").replace("\r", "\n")
    return extract.decoded(bytes(content)) if content is not None else None


def _facts(content, wanted: str):
    source = _source(content)
    return [f for f in extract.python_facts(source) if f[0] == wanted] if source is not None else []


class PythonSymbols:
    def eval(self, content):
        for _, section, name, line, signature, docstring, _ in _facts(content, "symbol"):
            yield section, name, line, signature, docstring


class PythonImports:
    def eval(self, content):
        for module in sorted({f[2] for f in _facts(content, "import")}):
            yield (module,)


class PythonCalls:
    """One row for each caller and callee, with the line that is visited first."""

    def eval(self, content):
        seen: dict[tuple[str, str], int] = {}
        for _, _, callee, line, _, _, caller in _facts(content, "call"):
            seen.setdefault((caller, callee), line)
        for (caller, callee), line in seen.items():
            yield caller, callee, line


class OutlineSymbols:
    def eval(self, content, ext):
        source = _source(content)
        if source is not None:
            yield from outline(source, ext or "")


#: Names that SQL calls, with the parser behind each and its columns.
TABLE_FUNCTIONS = {
    "python_symbols": (PythonSymbols, "section string, name string, line int, signature string, docstring string"),
    "python_imports": (PythonImports, "module string"),
    "python_calls": (PythonCalls, "caller string, callee string, line int"),
    "outline_symbols": (OutlineSymbols, "section string, name string, line int, signature string"),
}


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session's SQL."""
    for name, (parser, columns) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(parser, returnType=columns, useArrow=False))
