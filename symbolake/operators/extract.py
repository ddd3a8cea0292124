"""Row generators: symbols, imports and calls of source files.

Python is parsed with ``ast`` (one parse a file for all three kinds of rows).
JavaScript, TypeScript, Go and Rust have a built-in line backend made of Spark
expressions, and an optional syntax-tree backend.
"""

from __future__ import annotations

import ast
import functools
import importlib
from collections.abc import Callable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolake.functions import stripped
from symbolake.model import LANGUAGES, MODULE_CALLER

MODES = ("auto", "regex", "treesitter", "outline")

FACTS = "kind string, file string, ord long, section string, name string, line int, signature string, docstring string, caller string"
#: ``ord`` of a row: that of its file, and its place within the file.
PER_FILE = 1 << 24
#: Tasks for each core that files are dealt to before they are parsed.
SHARE = 4


def python_facts(source: str) -> list[tuple]:
    """(kind, section, name, line, signature, docstring, caller) in order of visit; none if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple] = []
    todo: list[tuple[ast.AST, tuple[str, ...], str]] = [(tree, (), MODULE_CALLER)]
    while todo:
        node, classes, caller = todo.pop()
        match node:
            case ast.ClassDef(name=name):
                out.append(("symbol", "python_classes", name, node.lineno, f"class {name}", ast.get_docstring(node) or "", None))
                classes = (*classes, name)
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                caller = ".".join((*classes, node.name))
                names = ", ".join(a.arg for a in node.args.args)
                section = "python_methods" if classes else "python_functions"
                out.append(("symbol", section, caller, node.lineno, f"def {caller}({names})", ast.get_docstring(node) or "", None))
            case ast.Import(names=names):
                out += [("import", None, a.name, node.lineno, None, None, None) for a in names]
            case ast.ImportFrom(module=module, names=names, level=level):
                targets = [module] if module else [a.name for a in names]
                out += [("import", None, "." * level + t, node.lineno, None, None, None) for t in targets]
            case ast.Call(func=ast.Name(id=callee)) | ast.Call(func=ast.Attribute(attr=callee)):
                out.append(("call", None, callee, node.lineno, None, None, caller))
        todo += [(child, classes, caller) for child in reversed([*ast.iter_child_nodes(node)])]
    return out


def decoded(content: bytes) -> str | None:
    try:
        return content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError:
        return None


def facts_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["kind", "file", "ord", "section", "name", "line", "signature", "docstring", "caller"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    columns = [*zip(*rows, strict=True)] if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _python(batches):
    for batch in batches:
        rows = []
        for ord_, file, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            source = decoded(content or b"")
            for k, (kind, section, name, line, signature, docstring, caller) in enumerate(python_facts(source) if source is not None else ()):
                rows.append((kind, file, ord_ * PER_FILE + k, section, name, line, signature, docstring, caller))
        yield facts_batch(rows)


def spread(files: DataFrame) -> DataFrame:
    """Files dealt evenly to tasks, several for each core: a small table may come in one part, however long its files take to parse."""
    return files.repartition(SHARE * files.sparkSession.sparkContext.defaultParallelism, "ord")


def python_table(files: DataFrame) -> DataFrame:
    """Facts of all Python files of (ord, file, ext, content)."""
    return spread(files.where("ext = '.py'").select("ord", "file", "content")).mapInArrow(_python, FACTS)


def symbols_of(facts: DataFrame, language: str = "python") -> DataFrame:
    return facts.where("kind = 'symbol'").select("section", "name", "file", "line", "signature", "docstring", F.lit(language).alias("language"), "ord")


def imports_of(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'import'").select("file", F.col("name").alias("module")).distinct()


def calls_of(facts: DataFrame) -> DataFrame:
    """One row for each (file, caller, callee), with the line that is visited first."""
    return first_calls(facts.where("kind = 'call'").select("file", "caller", F.col("name").alias("callee"), "line", "ord"))


def first_calls(visits: DataFrame) -> DataFrame:
    """Deduplicate call edges: the line with the least ``ord`` of each (file, caller, callee)."""
    return visits.groupBy("file", "caller", "callee").agg(F.min_by("line", "ord").alias("line"))


# Declaration patterns of the line backend.
_JS = (
    (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+([A-Za-z_$][\w$]*)", "generic_functions"),
    (r"^\s*(?:export\s+)?class\s+([A-Za-z_$][\w$]*)", "generic_classes"),
)
LINE_RULES = {
    "javascript": _JS,
    "typescript": _JS,
    "go": ((r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(", "generic_functions"),),
    "rust": (
        (r"^\s*(?:pub\s+)?fn\s+([A-Za-z_]\w*)\s*[(<]", "generic_functions"),
        (r"^\s*(?:pub\s+)?struct\s+([A-Za-z_]\w*)", "generic_classes"),
    ),
}
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _line_rows(line: Column, language: str) -> Column:
    """Array of (section, name) of one line."""
    found = [F.struct(F.lit(section).alias("section"), F.regexp_extract(line, f"(?U){rule}", 1).alias("name")) for rule, section in LINE_RULES[language]]
    return F.filter(F.array(*found), lambda x: x["name"] != "")


def line_symbols(files: DataFrame, exts: list[str] | None = None) -> DataFrame:
    """Symbols by the line backend, all languages in one pass; a file that is not UTF-8 has none."""
    exts = [e for e in LANGUAGES if e != ".py"] if exts is None else exts
    languages = sorted({LANGUAGES[e] for e in exts})
    of = lambda pick: functools.reduce(lambda c, x: c.when(F.col("language") == x, pick(x)), languages[1:], F.when(F.col("language") == languages[0], pick(languages[0])))
    named = F.element_at(F.create_map(*(F.lit(x) for e in exts for x in (e, LANGUAGES[e]))), F.col("ext"))
    own = files.where(F.col("ext").isin(exts)).select("ord", "file", named.alias("language"), F.try_validate_utf8(F.col("content").cast("string")).alias("source"))
    lines = own.select("ord", "file", "language", F.posexplode(F.split("source", LINE_BREAK, -1)).alias("at", "text"))
    rows = lines.select("ord", "file", "language", "at", "text", F.posexplode(of(lambda x: _line_rows(F.col("text"), x))).alias("rule", "hit"))
    return rows.select(
        F.col("hit.section").alias("section"), F.col("hit.name").alias("name"), "file", (F.col("at") + 1).cast("int").alias("line"),
        stripped(F.col("text")).alias("signature"), F.lit("").alias("docstring"), "language",
        (F.col("ord") * PER_FILE + F.col("at") * 4 + F.col("rule")).alias("ord"),
    )


# Grammar packages and the attribute that gives each language.
GRAMMARS = {
    ".js": ("tree_sitter_javascript", "language"), ".jsx": ("tree_sitter_javascript", "language"),
    ".ts": ("tree_sitter_typescript", "language_typescript"), ".tsx": ("tree_sitter_typescript", "language_tsx"),
    ".go": ("tree_sitter_go", "language"), ".rs": ("tree_sitter_rust", "language"),
}


def grammar(ext: str):
    """The syntax-tree grammar of an extension, or None where it isn't installed."""
    try:
        core = importlib.import_module("tree_sitter")
        module, name = GRAMMARS[ext]
        return core.Language(getattr(importlib.import_module(module), name)())
    except (ImportError, KeyError):
        return None


def grammar_package(ext: str) -> str:
    return GRAMMARS[ext][0].replace("_", "-") if ext in GRAMMARS else "tree-sitter"


def backend(ext: str, mode: str = "auto") -> str | None:
    """Which backend reads an extension: ``ast``, ``treesitter``, ``regex``, ``outline`` or None."""
    if mode not in MODES:
        raise ValueError(f"unknown parser mode {mode!r}; available: {', '.join(MODES)}")
    if ext == ".py":
        return "ast"
    if ext not in GRAMMARS:
        return None
    if mode in ("regex", "outline"):
        return mode
    if grammar(ext) is not None:
        return "treesitter"
    if mode == "treesitter":
        raise RuntimeError(f"parser mode treesitter needs the grammar of {ext}: pip install {grammar_package(ext)}")
    return "regex"


def _say(node) -> str:
    return node.text.decode("utf-8", "replace") if node is not None else ""


def _field(name: str):
    return lambda node: _say(node.child_by_field_name(name))


def _child(*types: str):
    return lambda node: next((_say(c) for c in node.children if c.type in types), "")


def _type_in(name: str):
    """The first type identifier at or below a field, depth first."""

    def found(node) -> str:
        todo = [node.child_by_field_name(name)]
        while todo:
            at = todo.pop()
            if at is not None and at.type == "type_identifier":
                return _say(at)
            todo += reversed(at.children) if at is not None else ()
        return ""

    return found


def _holds(*types: str):
    return lambda node: any(c.type in types for c in node.children)


@dataclass(frozen=True)
class Declares:
    """What a node type declares: its section and name, under which owner, and what lies in it."""

    name: Callable | None = None
    section: str = ""
    #: Section where there is an owner around it; "" where the node then declares nothing else.
    member: str = ""
    #: Prefix of the name, if not the owner around it.
    owner: Callable | None = None
    #: Owner of what lies in the node; None leaves it as it is.
    opens: Callable | None = None
    enter: bool = True
    when: Callable = lambda node: True
    #: Whether a node that is the only one of its type in its parent is shown as the parent.
    shown_whole: bool = False


_NAMED = _child("identifier", "type_identifier")
_FUNCTION = Declares(_NAMED, "generic_functions", "generic_methods")
_SCRIPT = {
    "class_declaration": Declares(lambda n: _NAMED(n) or "?", "generic_classes", opens=lambda n: _NAMED(n) or "?"),
    "method_definition": Declares(_child("property_identifier"), "", "generic_methods"),
    "function_declaration": _FUNCTION,
    "variable_declarator": replace(_FUNCTION, when=_holds("arrow_function", "function_expression")),
}
_RUST_TYPE = Declares(_field("name"), "generic_classes", enter=False)
#: Node types that declare something, by language.
DECLARATIONS = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "go": {
        "function_declaration": Declares(_field("name"), "generic_functions", enter=False),
        "method_declaration": Declares(_field("name"), "generic_functions", owner=_type_in("receiver"), enter=False),
        "type_spec": Declares(_field("name"), "generic_classes", enter=False, when=lambda n: getattr(n.child_by_field_name("type"), "type", "") == "struct_type", shown_whole=True),
    },
    "rust": {
        "impl_item": Declares(opens=_type_in("type")),
        "function_item": Declares(_field("name"), "generic_functions", "generic_functions", enter=False),
        "struct_item": _RUST_TYPE,
        "enum_item": _RUST_TYPE,
    },
}


def tree_symbols(root, language: str) -> list[tuple[str, str, int, str]]:
    """(section, name, line, signature) of the declarations of a syntax tree, in order of the source."""
    rules, out = DECLARATIONS[language], []
    todo = [(c, root, "") for c in reversed(root.children)]
    while todo:
        node, parent, owner = todo.pop()
        rule, within = rules.get(node.type), owner
        if rule is not None:
            section = rule.member if owner and rule.member else rule.section
            name = rule.name(node) if rule.name and section and rule.when(node) else ""
            if name:
                prefix = rule.owner(node) if rule.owner else owner if rule.member else ""
                alone = rule.shown_whole and sum(c.type == node.type for c in parent.children) == 1
                shown = parent if alone else node
                first = (_say(shown).splitlines() or [""])[0].strip()
                out.append((section, f"{prefix}.{name}" if prefix else name, shown.start_point[0] + 1, first))
            within = rule.opens(node) if rule.opens else owner
            if not rule.enter:
                continue
        todo += [(c, node, within) for c in reversed(node.children)]
    return out


def _tree(batches):
    from tree_sitter import Parser

    parsers: dict = {}
    for batch in batches:
        rows = []
        for ord_, file, content, ext in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if ext not in parsers:
                parsers[ext] = Parser(grammar(ext))
            root = parsers[ext].parse(content).root_node
            for k, (section, name, line, signature) in enumerate(tree_symbols(root, LANGUAGES[ext])):
                rows.append(("symbol", file, ord_ * PER_FILE + k, section, name, line, signature, "", None))
        yield facts_batch(rows)


def generic_symbols(files: DataFrame, mode: str = "auto", exts: list[str] | None = None) -> DataFrame:
    """Symbols of all files but Python's, each extension by its backend."""
    exts = [e for e in LANGUAGES if e != ".py"] if exts is None else exts
    by = {e: backend(e, mode) for e in exts}
    lined = [e for e in exts if by[e] == "regex"]
    out = line_symbols(files, lined) if lined else None
    if mode == "outline":
        from symbolake.operators.outline import outline_symbols  # reads with this module's tables

        return outline_symbols(files, exts)
    for language in sorted({LANGUAGES[e] for e in exts if by[e] == "treesitter"}):
        own = files.where(F.col("ext").isin([e for e in exts if by[e] == "treesitter" and LANGUAGES[e] == language]))
        rows = symbols_of(spread(own.select("ord", "file", "content", "ext")).mapInArrow(_tree, FACTS), language)
        out = rows if out is None else out.unionByName(rows)
    return out
