"""Source-symbol analytics on Spark: scan, look up, diff, embed, search, compare."""

from symbolake.operators.diff import diff_files, diff_symbols, summary
from symbolake.operators.lookup import callees_of, callers_of, find, section, unused
from symbolake.operators.vectors import search, similar
from symbolake.plans.snapshot import Snapshot, build, export

__all__ = ["Snapshot", "build", "callees_of", "callers_of", "diff_files", "diff_symbols", "export", "find", "search", "section", "similar", "summary", "unused"]
