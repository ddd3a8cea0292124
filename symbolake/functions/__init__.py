"""Scalar functions of the engine, as Column expressions."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column | str) -> Column:
    """A string column with null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def number(c: Column | str) -> Column:
    """An integer with null, empty and malformed as 0."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).try_cast("int"), F.lit(0))


def last_segment(c: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(c, ".", -1)


def stripped(c: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def glob_regex(glob: str) -> str:
    """A shell glob as a regular expression for whole paths; ``*`` crosses slashes."""
    return fnmatch.translate(glob).replace(r"\Z", r"\z")


def haystack() -> Column:
    """The searched text of a symbol: name, signature, docstring and file."""
    return F.lower(F.concat_ws(" ", text("name"), text("signature"), text("docstring"), text("file")))


def entry_key() -> Column:
    return F.concat_ws("::", text("section"), text("name"), text("file"), number("line").cast("string"))


def entry_text() -> Column:
    """Four lines, empty ones kept."""
    return F.concat_ws("\n", F.concat(text("section"), F.lit(" : "), text("name")), text("signature"), stripped(text("docstring")), F.concat(F.lit("file : "), text("file")))


def entry_hash(model: str, dim: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}|{dim}|"), entry_text()), 256)


def identity() -> Column:
    return F.concat_ws("::", text("section"), text("name"), text("file"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in order of the elements; empty vectors give 0."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """L2-normalised; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def recentred(v: Column, centre: Column) -> Column:
    """v minus the centroid, normalised; an absent vector stays empty."""
    moved = F.zip_with(v, centre, lambda x, c: x - c)
    none = F.array().cast("array<double>")
    return F.when(F.size(F.coalesce(v, none)) == 0, none).otherwise(F.element_at(F.transform(F.array(moved), unit), 1))
