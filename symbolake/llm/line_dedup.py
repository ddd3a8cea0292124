"""Line dedup by site-relative frequency.

Within a host, a line's ratio is the number of pages that have it, divided by
the host's pages. Lines whose ratio exceeds RATIO and which repeat, that is stand
on MIN_PAGES = 2 pages or more, are boilerplate of that site and are dropped from
every page of it. So the ratio alone decides for a host of any size but one: the
only page of a host repeats nothing and loses nothing.

Only hashes of lines move: (host, line) counts are pre-aggregated, and what
comes back to a page is the places of its boilerplate lines. The join of pages and
boilerplate lines goes by (host, line), so that a hot host is spread over its
lines; the share of one hot line is split by adaptive execution, or the lines
are broadcast while they are few.

Edge cases: a null or empty text has no lines and stays null or empty. A null
host is a host of its own. A line counts once a page however often it stands
there; each of its places goes. Lines are compared by a 64-bit hash of their
trimmed text; blank lines are kept and never counted. Rows with equal ids are separate pages. A very
long page moves whole, once, and its lines as hashes; time is linear in its lines. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolake.llm.base import fits, let, stash

RATIO = 0.05
MIN_PAGES = 2

#: The rest of a tag after its name: a ">" within a quoted value does not end it.
REST = r"""[^>=]*(?:=\s*(?:"[^"]*"|'[^']*')?[^>=]*)*>"""
#: The same without going back, so that Java needs no recursion on tags of many attributes.
REST_ONCE = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>"""
#: Elements that begin and end a line of the visible page.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"


def host_of(url: Column) -> Column:
    """Host name of a URL, lower-case, without user and port; null without one."""
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def visible_lines(html: Column) -> Column:
    """The page's blocks, one a line; scripts, styles, comments and tags go."""
    text = F.regexp_replace(html, r"(?s)<(?:!--.*?-->|([sS](?:[cC][rR][iI][pP][tT]|[tT][yY][lL][eE]))\b.*?</\1\s*>)", "")
    text = F.regexp_replace(text, r"[\n\r\t]", " ")
    text = F.regexp_replace(text, rf"</?(?i:{BLOCKS})\b{REST_ONCE}", "\n")
    text = F.regexp_replace(text, rf"<[A-Za-z/!?]{REST_ONCE}", "")
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, " {2,}", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def drop_boilerplate(pages: DataFrame, key: str, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """key, host, text without boilerplate lines, n_lines and n_dropped (non-blank lines) of every page."""
    # one hash for each line, null for a blank one
    hashes = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))
    rows = pages.select(F.col(key), host.alias("host"), text.alias("text")).withColumn("row_", F.monotonically_increasing_id())
    # the hashes of a page's lines are written beside its text, so that counting reads no text
    rows = stash(rows.withColumn("hashes_", hashes), "pages")
    hashed = rows.select("row_", "host", F.explode(F.array_distinct("hashes_")).alias("line")).where("line is not null")
    of_host = stash(rows.groupBy("host").agg(F.count("*").alias("n_pages")), "hosts")
    counts = hashed.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    counts = counts.withColumnRenamed("host", "h")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    few = F.broadcast(of_host) if fits(of_host) else of_host
    often = counts.join(few, same("h", "host")).where(F.col("n") > ratio * F.col("n_pages")).select("h", F.col("line").alias("l"))
    often = stash(often, "boilerplate")
    side = F.broadcast(often) if fits(often) else often
    # what comes back to a page is the places of its boilerplate lines; all further steps are linear in its lines
    placed = rows.select("row_", "host", F.posexplode("hashes_").alias("at", "line")).where("line is not null")
    hits = placed.join(side, same("host", "h") & (F.col("line") == F.col("l"))).groupBy("row_").agg(F.collect_list("at").alias("drop_"))
    joined = rows.join(hits, "row_", "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("hashes_") - 1), F.col("drop_"))
    left = let(F.split("text", "\n", -1), lambda lines: F.transform(kept, lambda i: F.get(lines, i)))
    return joined.select(
        key,
        "host",
        F.when(F.col("drop_").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
        F.size(F.filter("hashes_", lambda x: x.isNotNull())).cast("long").alias("n_lines"),
        F.when(F.col("drop_").isNull(), 0).otherwise(F.size("drop_")).cast("long").alias("n_dropped"),
    )


ORACLE = r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host,
   regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '[\n\r\t]', ' ', 'g'),
   '(?i)</?(?:@BLOCKS@)\b@REST@', chr(10), 'g'), '<[A-Za-z/!?]@REST@', '', 'g') AS t FROM pages),
l AS (SELECT r, page_id, host, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, ' {2,}', ' ', 'g'))), lambda x: x <> '') AS l FROM p),
n AS (SELECT host, count(*) AS n FROM p GROUP BY host),
d AS (SELECT host, x, count(*) AS k FROM (SELECT host, unnest(list_distinct(l)) AS x FROM l) GROUP BY ALL),
o AS (SELECT d.host, list(x) AS drops FROM d JOIN n ON d.host IS NOT DISTINCT FROM n.host WHERE k >= 2 AND k > 0.05 * n GROUP BY d.host),
f AS (SELECT page_id, l.host, l, list_filter(l, lambda x: NOT list_contains(coalesce(drops, []), x)) AS kept FROM l LEFT JOIN o ON l.host IS NOT DISTINCT FROM o.host)
SELECT page_id, host, array_to_string(kept, chr(10)) AS text, len(l)::BIGINT AS n_lines, (len(l) - len(kept))::BIGINT AS n_dropped FROM f
""".replace("@BLOCKS@", BLOCKS).replace("@REST@", REST.replace("'", "''"))
