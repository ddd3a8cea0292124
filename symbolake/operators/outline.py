"""Outlines of JavaScript, TypeScript, Go and Rust files without a grammar package.

A file is read once from left to right: comments, strings, templates and regular
expressions are passed over, brackets are kept on a stack, and each bracket knows
the class or type that owns what lies in it. Declarations are told by the words
around them. The rows are those of the syntax-tree backend: methods carry their
class, Go methods their receiver, functions of an ``impl`` its type; signatures
without a body (overloads, interface and trait members) are none.

It reads well-formed files; in a broken one it finds what still looks like a
declaration and never fails. What only a grammar can tell (a regular expression
after a closing bracket, type arguments that hold braces) may be misread.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolake.model import LANGUAGES
from symbolake.operators.extract import FACTS, PER_FILE, decoded, facts_batch, spread, symbols_of

EXTS = tuple(e for e in LANGUAGES if e != ".py")

_WORD = r"(?P<word>[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*)"
_REST = r"(?P<number>\d[\w.]*)|(?P<mark>=>|->|::|[^\s\w])"
_C_COMMENT = r"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z))"
_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\""
_TOKENS = {
    "script": re.compile(rf"{_C_COMMENT}|(?P<text>{_QUOTED}|'(?:[^'\\\n]|\\.)*')|(?P<regex>/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*)|{_WORD}|{_REST}", re.S),
    "go": re.compile(rf"{_C_COMMENT}|(?P<text>{_QUOTED}|'(?:[^'\\\n]|\\.)+'|`[^`]*`)|{_WORD}|{_REST}", re.S),
    "rust": re.compile(rf"(?P<skip>//[^\n]*)|(?P<nested>/\*)|(?P<text>\bb?r(?P<hashes>#*)\".*?\"(?P=hashes)|b?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\[^\n]+?)')|(?P<life>'\w+)|{_WORD}|{_REST}", re.S),
}
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_OPEN, _CLOSE = "([{", ")]}"
#: After these a slash begins a regular expression, and a function or class is an expression.
_OPERATORS = {*"=([{,;:!&|?+-*%~^<>", "=>", "return", "typeof", "case", "in", "of", "new", "delete", "void", "throw", "else", "do", "await", "yield"}
_VALUE_BEFORE = {*"=([,:!&|?+-*%~^<>", "=>", "return", "typeof", "case", "in", "of", "new", "delete", "void", "throw", "await", "yield", "extends"}
_MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "declare", "accessor"}
_NO_NAME = {"if", "for", "while", "switch", "catch", "with", "return", "function", "super", "await", "typeof"}


@dataclass(slots=True)
class Token:
    text: str
    at: int
    end: int
    kind: str
    line: int
    #: Place of the bracket that closes or opens this one; -1 for others.
    mate: int = -1


def tokens(source: str, family: str) -> list[Token]:
    """Words, numbers, strings and marks of a file, with the brackets paired."""
    found: list[Token] = []
    pattern, at, line, seen = _TOKENS[family], 0, 1, 0
    braces: list[bool] = []  # whether a brace was opened inside a template

    def add(text: str, kind: str, start: int, end: int) -> None:
        nonlocal line, seen
        line, seen = line + source.count("\n", seen, start), start
        found.append(Token(text, start, end, kind, line))

    def template(begin: int, start: int) -> int:
        """Passes over a template's text; inside ${ } it is code again."""
        end = _TEMPLATE.match(source, begin).end()
        if source[end : end + 1] == "$":
            add("{", "mark", end, end + 2)
            braces.append(True)
            return end + 2
        add("`", "text", start, end + 1)
        return end + 1

    while at < len(source):
        m = pattern.match(source, at)
        if m is None:
            at += 1
            continue
        kind, start, text = m.lastgroup, m.start(), m[0]
        if kind == "hashes":
            kind = "text"
        at = m.end()
        if kind == "nested":
            depth = 1
            while depth and (mark := re.compile(r"/\*|\*/").search(source, at)):
                depth, at = depth + (1 if mark[0] == "/*" else -1), mark.end()
            at = len(source) if depth else at
        elif kind == "regex":
            last = found[-1] if found else None
            if last is None or last.text in _OPERATORS or last.text == "}":
                add("//", "text", start, at)
            else:
                add("/", "mark", start, start + 1)
                at = start + 1
        elif family == "script" and text == "`":
            at = template(at, start)
        elif kind != "skip":
            if text == "{":
                braces.append(False)
            if text == "}" and braces and braces.pop():
                add("}", "mark", start, at)
                at = template(at, start)
            else:
                add(text, kind, start, at)
    open_: list[int] = []
    for i, t in enumerate(found):
        if t.kind == "mark" and t.text in _OPEN:
            open_.append(i)
        elif t.kind == "mark" and t.text in _CLOSE:
            pair = _OPEN[_CLOSE.index(t.text)]
            if any(found[k].text == pair for k in open_[-8:]):
                while (k := open_.pop()) >= 0 and found[k].text != pair:
                    pass
                found[k].mate, t.mate = i, k
    return found


class Reader:
    """Tokens of one file, and the rows found in it."""

    def __init__(self, source: str, family: str):
        self.source, self.tokens = source, tokens(source, family)
        self.rows: list[tuple[str, str, int, str]] = []

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def past(self, i: int) -> int:
        """The token after a bracket's mate; the end where it is never closed."""
        return self.tokens[i].mate + 1 if self.tokens[i].mate > i else len(self.tokens)

    def past_angles(self, i: int) -> int:
        """The token after type parameters that begin at i, if any."""
        if self.text(i) != "<":
            return i
        depth = 0
        while i < len(self.tokens):
            x = self.text(i)
            depth += (x == "<") - (x == ">")
            if x in _OPEN and self.tokens[i].kind == "mark":
                i = self.past(i) - 1
            i += 1
            if not depth:
                break
        return i

    def body(self, i: int, stop: str = ";") -> int:
        """The brace that opens a body after i, past bracketed parts; -1 where a stop or the enclosing end comes first."""
        while i < len(self.tokens) and self.text(i) not in stop and not (self.tokens[i].kind == "mark" and self.text(i) in _CLOSE):
            if self.text(i) == "{" and self.text(i - 1) not in (":", "<", "|", "&"):  # else a type
                return i
            i = self.past(i) if self.tokens[i].kind == "mark" and self.text(i) in _OPEN else i + 1
        return -1

    def emit(self, section: str, name: str, first: int, end: int = -1, value: int = -1) -> None:
        """A row for the tokens from first to before end (where that is open, of the statement that goes on at value), shown by their first line."""
        t = self.tokens[first]
        if end < 0:
            end = max(value, first + 1)
            while end < len(self.tokens) and self.tokens[end].line == t.line and not (self.tokens[end].kind == "mark" and self.text(end) in ";,)]}"):
                end = self.past(end) if self.tokens[end].kind == "mark" and self.text(end) in _OPEN else end + 1
        stop = self.tokens[end - 1].end
        if self.tokens[end - 1].line > t.line:
            stop = self.source.find("\n", t.at, stop)
        self.rows.append((section, name, t.line, self.source[t.at : stop].split("\n", 1)[0].strip()))


def script(source: str) -> list[tuple[str, str, int, str]]:
    """(section, name, line, signature) of JavaScript or TypeScript."""
    r = Reader(source, "script")
    opens: dict[int, tuple[str, str | None]] = {}  # brace -> what it is, and the owner inside it
    stack: list[tuple[str, str]] = [("block", "")]
    declaring = -1  # depth of a declaration of variables

    def named(section: str, name: str, first: int, owner: str, end: int = -1, value: int = -1) -> None:
        r.emit("generic_methods" if owner else section, f"{owner}.{name}" if owner else name, first, end, value)

    def begins(i: int) -> bool:
        """Whether a declaration may begin at i: no operator before it that takes a value."""
        return i == 0 or r.text(i - 1) not in _VALUE_BEFORE or r.tokens[i - 1].kind in ("text", "number") or (r.text(i - 1) == ">" and r.tokens[i - 1].line < r.tokens[i].line)

    def function_at(i: int) -> int:
        """Where an arrow function or plain function that begins at i goes on (its body or value, or its end); -1 where none begins."""
        i += r.text(i) == "async" and r.text(i + 1) != "=>"
        if r.text(i) == "function":
            return -1 if r.text(i + 1) == "*" else max(r.body(i + 1), i + 1)
        i = r.past_angles(i)
        if r.is_word(i):
            return i + 2 if r.text(i + 1) == "=>" else -1
        if r.text(i) != "(":
            return -1
        i = r.past(i)
        if r.text(i) == ":":  # a result type ends at the arrow
            while i < len(r.tokens) and r.text(i) not in ("=>", ";", "=", ",", ")", "}"):
                i = r.past(i) if r.text(i) in _OPEN else i + 1
        return i + 1 if r.text(i) == "=>" else -1

    for i, t in enumerate(r.tokens):
        kind, owner = stack[-1]
        x = t.text
        if t.kind == "mark" and x in _OPEN:
            if x == "{" and i in opens:
                what, inside = opens[i]
                stack.append((what, owner if inside is None else inside))
            elif x == "{" and r.text(i - 1) in _VALUE_BEFORE and r.text(i - 1) != "=>":
                stack.append(("object", owner))
            else:
                stack.append(("block" if x == "{" else "list", owner))
        elif t.kind == "mark" and x in _CLOSE:
            if len(stack) > 1 and t.mate >= 0:
                stack.pop()
        elif x == ";":
            declaring = -1
        elif t.kind != "word":
            continue
        elif kind in ("class", "object") and r.text(i - 1) != ".":
            first = i
            while first and (r.text(first - 1) in _MODIFIERS or r.text(first - 1) == "*") and r.tokens[first - 1].kind != "text":
                first -= 1
            before = r.text(first - 1)
            starts = before in "{,;}" or (kind == "class" and (before == ")" or r.tokens[first - 1].line < r.tokens[first].line) and before not in _VALUE_BEFORE)
            at = r.past_angles(i + 1)
            if starts and r.text(at) == "(" and x not in ("function",):
                b = r.body(r.past(at), ";=" if kind == "class" else ";,")
                if b >= 0:
                    opens[b] = ("block", None)
                    if owner and x[0] not in "#@":
                        r.emit("generic_methods", f"{owner}.{x}", first, r.past(b))
            elif kind == "object" and x == "function":
                opens[r.body(i)] = ("block", None)
        elif x == "class" and r.text(i - 1) != ".":
            name = r.text(i + 1) if r.is_word(i + 1) and r.text(i + 1) not in ("extends", "implements") else ""
            b = r.body(r.past_angles(i + 1 + bool(name)))
            whole = bool(name) and begins(i) and r.text(i - 1) != "abstract"
            opens[b] = ("class", name if whole else None)
            if whole and b >= 0:
                r.emit("generic_classes", name, i, r.past(b))
        elif x == "function" and r.text(i - 1) != ".":
            first = i - (r.text(i - 1) == "async")
            name = r.text(i + 1) if r.is_word(i + 1) else ""
            b = r.body(r.past_angles(i + 1 + bool(name) + (r.text(i + 1) == "*")), ";")
            opens[b] = ("block", None)
            if name and b >= 0 and begins(first):
                named("generic_functions", name, first, owner, r.past(b))
        elif x in ("const", "let", "var") and r.text(i - 1) != ".":
            declaring = len(stack)
        if t.kind == "word" and declaring == len(stack) and r.text(i - 1) in ("const", "let", "var", ",") and x not in _NO_NAME:
            at = i + 1
            if r.text(at) == ":":
                while at < len(r.tokens) and r.text(at) not in ("=", ";", ")", "}"):
                    at = r.past(at) if r.text(at) in _OPEN else at + 1
            value = function_at(at + 1) if r.text(at) == "=" else -1
            if value >= 0:
                named("generic_functions", x, i, owner, r.past(value) if r.text(value) == "{" else -1, value)
    return r.rows


def go(source: str) -> list[tuple[str, str, int, str]]:
    r, i = Reader(source, "go"), 0
    while i < len(r.tokens):
        x = r.text(i)
        if x == "func":
            at, owner = i + 1, ""
            if r.text(at) == "(":
                inner = [k for k in range(at + 1, r.past(at) - 1) if r.is_word(k)]
                # (s *S[T]) and (S): the type is the word after the name, or the only one
                after = [k for j, k in pairwise(inner) if k == j + 1 or all(r.text(m) == "*" for m in range(j + 1, k))]
                owner = r.text(after[0] if after and after[0] == inner[1] else inner[0]) if inner else ""
                at = r.past(at)
            name = r.text(at) if r.is_word(at) else ""
            at += 1
            at = r.past(at) if r.text(at) == "[" else at
            at = r.past(at) if r.text(at) == "(" else at
            line = r.tokens[at - 1].line if at <= len(r.tokens) else 0
            # the body opens on the line where the parameters or results end; without one there is none
            while at < len(r.tokens) and r.tokens[at].line == line and r.text(at) != "{":
                step = r.past(at) if r.tokens[at].kind == "mark" and r.text(at) in _OPEN else at + 1
                if r.text(at) in ("interface", "struct") and r.text(at + 1) == "{":
                    step = r.past(at + 1)
                at, line = step, r.tokens[min(step, len(r.tokens)) - 1].line
            end = r.past(at) if at < len(r.tokens) and r.text(at) == "{" and r.tokens[at].line == line else at
            if name:
                r.emit("generic_functions", f"{owner}.{name}" if owner else name, i, end)
            i = end
        elif x == "type":
            grouped = r.text(i + 1) == "("
            end = r.past(i + 1) if grouped else len(r.tokens)
            at, specs = i + 1 + grouped, []
            while at < end and r.is_word(at):
                name, line = at, r.tokens[at].line
                at += 1
                if r.text(at) == "[" and r.text(at + 1) != "]" and r.is_word(at + 1) and r.is_word(at + 2):
                    at = r.past(at)  # type parameters
                struct = r.text(at) == "struct"
                alias = r.text(at) == "="
                specs.append([name, struct and not alias, at])
                while at < end and r.tokens[at].line == line and r.text(at) != ";" and not (grouped and at == end - 1):
                    at = r.past(at) if r.tokens[at].kind == "mark" and r.text(at) in _OPEN else at + 1
                    line = r.tokens[at - 1].line
                specs[-1][2] = at
                at += r.text(at) == ";"
                if not grouped:
                    break
            for name, struct, stop in specs:
                if struct:
                    r.emit("generic_classes", r.text(name), *((i, end if grouped else at) if len(specs) == 1 else (name, stop)))
            i = end if grouped else at
        elif r.tokens[i].kind == "mark" and x in _OPEN:
            i = r.past(i)
        else:
            i += 1
    return r.rows


_RUST_BEFORE = {"pub", "async", "unsafe", "const", "extern", "default"}


def rust(source: str) -> list[tuple[str, str, int, str]]:
    r = Reader(source, "rust")
    todo = [(0, len(r.tokens), "")]
    while todo:
        i, end, owner = todo.pop()
        while i < end:
            x = r.text(i)
            first = i
            while first and (r.text(first - 1) in _RUST_BEFORE or (r.tokens[first - 1].kind == "text" and r.text(first - 2) == "extern") or (r.text(first - 1) == ")" and r.tokens[first - 1].mate > 0 and r.text(r.tokens[first - 1].mate - 1) == "pub")):
                first = r.tokens[first - 1].mate if r.text(first - 1) == ")" else first - 1
            if x == "!" and r.is_word(i - 1):  # a macro's tokens are no code
                i += 1 + r.is_word(i + 1)
                i = r.past(i) if r.text(i) in _OPEN and i < end else i
            elif x == "fn" and r.is_word(i + 1):
                b = r.body(r.past_angles(i + 2))
                if b >= 0:
                    r.emit("generic_functions", f"{owner}.{r.text(i + 1)}" if owner else r.text(i + 1), first, r.past(b))
                    i = r.past(b)
                else:
                    i += 2
            elif x in ("struct", "enum") and r.is_word(i + 1):
                name, at = r.text(i + 1), i + 2
                while at < end and r.text(at) not in (";", "{"):
                    at = r.past(at) if r.tokens[at].kind == "mark" and r.text(at) in _OPEN else at + 1
                if at < end and r.text(at) == "{":
                    at = r.past(at)
                else:
                    at = min(at + 1, end)
                r.emit("generic_classes", name, first, at)
                i = at
            elif x == "impl":
                at = r.past_angles(i + 1)
                b = r.body(at)
                whole = [k for k in range(at, b if b >= 0 else at)]
                depth, name, where = 0, "", False
                for k in whole:
                    depth += (r.text(k) == "<") - (r.text(k) == ">")
                    if r.text(k) == "for" and not depth and r.text(k + 1) != "<":
                        name = ""  # impl Trait for Type
                    elif r.text(k) == "where" and not depth:
                        where = True
                    elif r.is_word(k) and not name and not where and r.text(k) not in ("dyn", "mut", "const") and r.text(k + 1) != "::":
                        name = r.text(k)
                if b >= 0:
                    todo.append((r.past(b), end, owner))
                    i, end, owner = b + 1, r.past(b) - 1, name
                    continue
                i += 1
            elif x == "{" and r.tokens[i].mate > i:  # modules, traits
                i += 1
            else:
                i = r.past(i) if r.tokens[i].kind == "mark" and x in "([" else i + 1
    return r.rows


_READERS = {"javascript": script, "typescript": script, "go": go, "rust": rust}


def outline(source: str, ext: str) -> list[tuple[str, str, int, str]]:
    """(section, name, line, signature) of a file's declarations, in order."""
    return _READERS[LANGUAGES[ext]](source) if ext in EXTS else []


def _run(batches):
    for batch in batches:
        rows = []
        for ord_, file, content, ext in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            source = decoded(content or b"")
            for k, (section, name, line, signature) in enumerate(outline(source, ext) if source is not None else ()):
                rows.append(("symbol", file, ord_ * PER_FILE + k, section, name, line, signature, "", None))
        yield facts_batch(rows)


def outline_symbols(files: DataFrame, exts: list[str] | None = None) -> DataFrame:
    """Symbols of (ord, file, ext, content) by outline; a file that is not UTF-8 has none."""
    own = files.where(F.col("ext").isin([*(EXTS if exts is None else exts)]))
    facts = spread(own.select("ord", "file", "content", "ext")).mapInArrow(_run, FACTS)
    named = F.create_map(*(F.lit(x) for e in EXTS for x in (e, LANGUAGES[e])))
    language = F.element_at(named, F.concat(F.lit("."), F.substring_index("file", ".", -1)))
    return symbols_of(facts).withColumn("language", language)
