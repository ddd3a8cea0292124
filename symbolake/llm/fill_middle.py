"""Fill-in-middle transformation over run-length coded character classes.

A text is cut into units: a stretch of letters A-Z, a-z is one unit, any other
character is one. The code of a text is its maximal stretches of one class
(letters or others) with the units that end before each. The place of a cut after
k units is found in that code: a binary search gives the stretch that holds the
cut, and its offset follows from the units left over (none inside a stretch of
letters, one character each in any other). No unit is ever listed.

Two cuts split a text into prefix, middle and suffix, which are put down with
sentinels, as prefix-suffix-middle (``psm``) or suffix-prefix-middle (``spm``); a
share of the texts stays ``plain``. All draws come from the SHA-256 of seed and
doc_id, so that reruns and retried tasks agree.

Edge cases: null and empty texts are plain and give an empty output. A text that
holds a sentinel is plain, so that every output can be taken apart again. Rows with
equal doc_id get equal draws; a null doc_id draws as an empty string. Bytes that
are no UTF-8 count as U+FFFD. Very long texts take about ten bytes a character
while they are cut. An empty table gives no rows. Other columns are kept, but for
those named like a result, which are replaced.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolake.llm.base import small_batches
from symbolake.llm.textkernel import valid

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares in hundredths: texts that are transformed, and of these those with the suffix first.
RATE, SUFFIX_FIRST = 90, 20

ADDED = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
])


class Runs:
    """The run-length code of a text: first character, class and units before each stretch."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        folded = codes | np.uint32(32)
        letter = (folded >= 97) & (folded <= 122)
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        self.start = np.concatenate([[0], edges]) if len(codes) else np.zeros(0, np.int64)
        self.letters = letter[self.start]
        size = np.diff(np.append(self.start, len(codes)))
        self.before = np.concatenate([[0], np.cumsum(np.where(self.letters, 1, size))])
        self.chars, self.units = len(codes), int(self.before[-1])

    def offset(self, k: int) -> int:
        """Characters before the cut that has k units before it."""
        if k >= self.units:
            return self.chars
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.start[run]) + (0 if self.letters[run] else k - int(self.before[run]))


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def cut(text: str, h: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and middle, and output of one text."""
    runs = Runs(text)
    if not text or h[2] % 100 >= RATE or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return runs.units, "plain", None, None, text
    low, high = sorted((h[0] % (runs.units + 1), h[1] % (runs.units + 1)))
    a, b = runs.offset(low), runs.offset(high)
    if h[3] % 100 < SUFFIX_FIRST:
        return runs.units, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return runs.units, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def transform(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The rows of ``docs`` with n (units), form, prefix_chars, middle_chars and output."""
    small_batches(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED.names))

    def batches(it):
        for batch in it:
            ids, texts = batch.column("doc_id").to_pylist(), valid(batch.column("text"))
            rows = [cut(x.as_py(), draws(seed, i)) for i, x in zip(ids, texts, strict=True)]
            added = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *ADDED.names])

    return docs.mapInArrow(batches, T.StructType([*docs.schema.fields, *ADDED.fields]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No part holds a sentinel, so each is cut off whole."""
    middle, head = F.substring_index(output, MIDDLE, -1), F.substring_index(output, MIDDLE, 1)
    first = lambda mark, opening: F.substr(F.substring_index(head, mark, 1), F.lit(len(opening) + 1))
    return (
        F.when(form == "psm", F.concat(first(SUFFIX, PREFIX), middle, F.substring_index(head, SUFFIX, -1)))
        .when(form == "spm", F.concat(F.substring_index(head, PREFIX, -1), middle, first(PREFIX, SUFFIX)))
        .otherwise(output)
    )


def digest(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, and SHA-256 of the output and of the text restored from it."""
    out = transform(docs.select("doc_id", "text"), seed)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1 : a], ''), '') AS x, coalesce(array_to_string(u[a + 1 : b], ''), '') AS m, coalesce(array_to_string(u[b + 1 :], ''), '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || x || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
