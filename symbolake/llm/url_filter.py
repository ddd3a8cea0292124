"""URL filters: given host and path rules first, then association rules mined from labels.

Tokens of a url are its scheme, the last two to four labels of its host, the words
of its host, its directories, the words of its path, its file extension, and the
names of its query's parameters. A set of tokens is a rule when at least MIN_BAD of
the labelled urls that have it, and a share MIN_SUPPORT of all labelled urls, are bad,
and when bad ones are MIN_CONFIDENCE of all that have it. A rule goes when another has
all of its tokens but one. A url is blocked when it has all tokens of a rule.

All tokens of all labelled urls are mined, level by level, a set of k+1 tokens from two
of k tokens that differ in the last. Three things keep that from listing every subset of
a common part, and lose no rule. Tokens that are in too few bad urls can be in no rule
and go first. Tokens that the same labelled urls have are one class, and rules ask for
any token of each class. And a set goes, with all larger ones, when the same good urls
have it without one of its tokens: without that token, each such rule is one too, as as
many bad urls have it or more. Urls with the same classes left are counted as one row.
What is left may still be many sets, where urls have many common tokens that are in
different urls.

Matching is by an inverted index: each rule hangs on the tokens of its rarest class, the
tokens of distinct urls meet the index in a join, and a rule that is met is compared
whole. Only blocked urls come back to the table. So a token that a third of all urls
have brings a row for each rule that hangs on it, and none for a rule with a rarer one.

Given rules are looked up by the host's suffixes, as long as the longest rule's; the
longest host and path that fit win, and of equal ones block.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and has no tokens; it is allowed. An empty url is such a one. A very long url
gives as many tokens as it has parts, and four host suffixes at most. Rows with
equal page_id or url are judged one by one. Without labels, or without bad ones, no
rule is mined. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolake.llm.base import let, lookup, stash

ALLOW, BLOCK = "allow", "block"
#: Least bad urls of a rule, their least share in thousandths of labelled urls, and least share in hundredths of the urls that have the rule.
MIN_BAD, MIN_SUPPORT, MIN_CONFIDENCE = 10, 1, 60
#: Most tokens of a labelled url that are mined: None, as all are.
MAX_TOKENS = None


def host_and_path(url: Column) -> Column:
    """The struct of host (after the first ``://``, A-Z lower-cased) and path of a url; both are empty without one."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), F.lit(""))

    def cut(x):
        host = F.translate(F.regexp_extract(x, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return F.struct(host.alias("host"), F.regexp_extract(x, r"^[^/?#]*([^?#]*)", 1).alias("path"))

    return let(rest, cut)


def tokens(url: Column) -> Column:
    """The distinct tokens of a url; none where it has no ``://``."""

    def named(kind, values):
        return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), x))

    def of(parts):
        host, path = parts["host"], parts["path"]
        dirs = F.split(path, "/", -1)
        query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
        return F.concat(
            named("scheme", F.array(F.lower(F.substring_index(url, "://", 1)))),
            named("host", F.array(*(F.substring_index(host, ".", -k) for k in (2, 3, 4)))),
            named("hostword", F.split(host, "[.-]", -1)),
            named("dir", let(dirs, lambda x: F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))))),
            named("word", F.split(F.lower(path), r"[^\p{L}]+", -1)),
            named("type", F.array(F.regexp_extract(F.substring_index(path, "/", -1), r"\.([A-Za-z0-9]+)$", 1))),
            named("query", F.transform(F.split(query, "&", -1), lambda x: F.substring_index(x, "=", 1))),
        )

    found = F.array_distinct(let(host_and_path(url), of))
    return F.when(F.instr(url, "://") > 0, found).otherwise(F.array().cast("array<string>"))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The (verdict, rule) of the longest of the rules (verdict, host, path) that fits, or null."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, h, p in rules:
        if not h or verdict not in (ALLOW, BLOCK):
            raise ValueError(f"a rule needs a host, and allow or block: {verdict} {h}{p}")
        by_host.setdefault(h, []).append((verdict, p))
    kind = "array<struct<size:int,verdict:string,path:string,rule:string>>"
    if not rules:
        return F.lit(None).cast(kind[6:-1])
    entry = lambda h, v, p: F.struct(F.lit(len(h + p)).alias("size"), F.lit(v).alias("verdict"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"))
    index = F.create_map(*(x for h, own in by_host.items() for x in (F.lit(h), F.array(*(entry(h, v, p) for v, p in own)))))
    suffixes = F.array_distinct(F.array(*(F.substring_index(host, ".", -k) for k in sorted({h.count(".") + 1 for h in by_host}))))
    near = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(index, s), F.array().cast(kind))))
    return F.array_max(F.filter(near, lambda r: F.startswith(path, r["path"])))


def class_rules(labelled: DataFrame) -> DataFrame:
    """Rules from rows (url, bad): any_of, an array of (n_item, members), n_bad and n_all.

    A class is a set of tokens that the same labelled urls have, n_item of them; a rule
    asks for a token of each of its classes. Rows without a label count for nothing;
    equal rows count each.
    """
    # written once, so that the rows' numbers stay as they are
    rows = stash(labelled.where(F.col("bad").isNotNull()).select(F.monotonically_increasing_id().alias("id"), F.col("bad").cast("int").alias("bad"), tokens(F.col("url")).alias("t")), "labelled-urls")
    least = max(MIN_BAD, -(-rows.count() * MIN_SUPPORT // 1000))
    each = rows.select("id", "bad", F.explode("t").alias("item"))
    sums = F.count("*").alias("n_all"), F.sum("bad").alias("n_bad")
    # equal sets of urls have equal counts and equal xors of two hashes of their numbers
    marks = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    alike = each.groupBy("item").agg(*sums, *marks).where(F.col("n_bad") >= least).groupBy("n_all", "n_bad", "mark1", "mark2")
    classes = alike.agg(F.sort_array(F.collect_list("item")).alias("members")).select(F.monotonically_increasing_id().alias("class"), "members", "n_all", "n_bad")
    classes = stash(classes, "token-classes")
    own = lookup(each, stash(classes.select(F.explode("members").alias("item"), "class"), "url-tokens", few=True), ["item"], "inner")
    own = own.groupBy("id").agg(F.max("bad").alias("bad"), F.sort_array(F.collect_set("class")).alias("tails"))
    held = own.groupBy("tails").agg(*sums).withColumn("head", F.array().cast("array<long>"))
    sure = 100 * F.col("n_bad") >= MIN_CONFIDENCE * F.col("n_all")
    level = classes.select(F.array("class").alias("items"), "n_all", "n_bad", sure.alias("sure"), sure.alias("rule"))
    levels = [level]
    while True:
        held, level = next_level(held, level, least, sure)
        if level.isEmpty():
            break
        levels.append(level)
    found = reduce(DataFrame.unionByName, levels).where("rule").select("items", "n_bad", "n_all")
    named = classes.select("class", F.struct(F.col("n_all").alias("n_item"), "members").alias("of"))
    found = found.withColumn("class", F.explode("items")).join(named, "class")
    return stash(found.groupBy("items", "n_bad", "n_all").agg(F.sort_array(F.collect_list("of")).alias("any_of")).drop("items"), "url-rules", few=True)


def next_level(held: DataFrame, level: DataFrame, least: int, sure: Column) -> tuple[DataFrame, DataFrame]:
    """The kept sets that have one class more than those of ``level``, and the labelled urls that hold them.

    A row of ``held`` stands for n_all urls, n_bad of them bad, that have the classes
    ``head`` and, with each of the ascending ``tails``, a kept set. A new set is kept if at
    least ``least`` bad urls have it, and each of its classes keeps out a good url that
    has the others.
    """
    sums = F.sum("n_all").alias("n_all"), F.sum("n_bad").alias("n_bad")
    deeper = held.where(F.size("tails") > 1).select("head", "tails", "n_all", "n_bad", F.posexplode("tails").alias("i", "x"))
    deeper = deeper.where(F.col("i") + 1 < F.size("tails")).select(
        F.concat("head", F.array("x")).alias("head"), F.slice("tails", F.col("i") + 2, F.size("tails")).alias("tails"), "n_all", "n_bad"
    )
    deeper = stash(deeper.groupBy("head", "tails").agg(*sums), "held-classes")
    new = deeper.select("head", F.explode("tails").alias("x"), "n_all", "n_bad").groupBy("head", "x").agg(*sums).where(F.col("n_bad") >= least)
    new = stash(new.select(F.concat("head", F.array("x")).alias("items"), "n_all", "n_bad"), "class-sets")
    fewer = new.select("*", F.explode("items").alias("x")).withColumn("fewer", F.array_remove("items", F.col("x")))
    known = level.select(F.col("items").alias("fewer"), (F.col("n_all") - F.col("n_bad")).alias("good"), F.col("sure").alias("wider"))
    kept = fewer.join(known, "fewer").where(F.col("good") > F.col("n_all") - F.col("n_bad"))
    kept = kept.groupBy("items", "n_all", "n_bad").agg(F.count("*").alias("n"), F.max("wider").alias("wider")).where(F.col("n") == F.size("items"))
    # a rule says nothing beside one that lacks one of its items
    kept = stash(kept.select("items", "n_all", "n_bad", sure.alias("sure"), (sure & ~F.col("wider")).alias("rule")), "kept-sets", few=True)
    tails = kept.groupBy(F.slice("items", 1, F.size("items") - 1).alias("head")).agg(F.collect_list(F.element_at("items", -1)).alias("kept_"))
    held = deeper.join(tails, "head").withColumn("tails", F.array_intersect("tails", "kept_"))
    return held.groupBy("head", "tails").agg(*sums), kept


def mine(labelled: DataFrame) -> DataFrame:
    """The rules of ``class_rules`` written out: items, n_bad and n_all (labelled urls that have all items), and key, the rarest item.

    As many rows as there are ways to take a token of each class; ``judge`` needs none of them.
    """
    pick = lambda done, of: F.flatten(F.transform(done, lambda x: F.transform(of["members"], lambda m: F.concat(x, F.array(F.struct(of["n_item"].alias("n_item"), m.alias("item")))))))
    ways = F.aggregate("any_of", F.array(F.array()).cast("array<array<struct<n_item:long,item:string>>>"), pick)
    rules = class_rules(labelled).select(F.explode(ways).alias("x"), "n_bad", "n_all")
    return rules.select(F.sort_array(F.transform("x", lambda i: i["item"])).alias("items"), "n_bad", "n_all", F.array_min("x")["item"].alias("key"))


def met(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls whose tokens ``t`` hold one of each class of a rule."""
    index = rules.select(F.explode(F.array_min("any_of")["members"]).alias("token_"), F.transform("any_of", lambda x: x["members"]).alias("any_of_"))
    each = urls.select("url", "t", F.explode("t").alias("token_"))
    found = lookup(each, index, ["token_"], "inner")
    return found.where(F.forall("any_of_", lambda x: F.arrays_overlap(x, F.col("t")))).select("url").distinct()


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule (of the given ones, or null) and verdict of every row, by the given rules or else the mined ones."""
    hits = stash(met(pages.select("url", tokens(F.col("url")).alias("t")), class_rules(labelled)), "blocked-urls", few=True)
    hits = hits.select("url", F.lit(True).alias("hit_"))
    joined = lookup(pages.select("page_id", "url"), hits, ["url"], "left")
    rows = joined.select("page_id", "hit_", host_and_path(F.col("url")).alias("x")).select("page_id", "hit_", "x.host", "x.path")
    rows = rows.withColumn("given", given_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("hit_"), BLOCK).otherwise(ALLOW)
    return rows.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", own).alias("verdict"))


def named_document(url: Column) -> Column:
    """The first number that is a whole part of a url's path, or begins one, as urls that carry the id of their document have it."""
    return F.regexp_extract(host_and_path(url)["path"], r"/([0-9]{1,18})(?![0-9])", 1).try_cast("long")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and bad (quality 0, or toxic) of the pages whose document has a label; several labels of one document are bad if one is."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    kinds = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return pages.select("url", named_document(F.col("url")).alias("doc_id")).join(kinds, "doc_id").select("url", "bad")


#: Rules of the registered query.
RULES = [(ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/")]

ORACLE = r"""
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
k AS (SELECT *, string_split(host, '.') AS hs, string_split(path, '/') AS ps FROM h),
t AS (SELECT DISTINCT url, path, CASE WHEN instr(url, '://') = 0 OR url IS NULL THEN [] ELSE list_distinct(flatten([
        ['scheme:' || lower(substring(url, 1, instr(url, '://') - 1))],
        ['host:' || array_to_string(hs[greatest(len(hs) - 1, 1) :], '.')], ['host:' || array_to_string(hs[greatest(len(hs) - 2, 1) :], '.')], ['host:' || array_to_string(hs[greatest(len(hs) - 3, 1) :], '.')],
        list_transform(regexp_split_to_array(host, '[.-]'), lambda x: 'hostword:' || x), list_transform(ps[1 : len(ps) - 1], lambda x: 'dir:' || x),
        list_transform(regexp_split_to_array(lower(path), '[^\p{L}]+'), lambda x: 'word:' || x), ['type:' || regexp_extract(ps[len(ps)], '\.([A-Za-z0-9]+)$', 1)],
        list_transform(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: 'query:' || string_split(x, '=')[1])])) END AS t FROM k),
c AS (SELECT url, path, list_filter(t, lambda x: NOT regexp_matches(x, '^(scheme|host|hostword|dir|word|type|query):$')) AS t FROM t),
b AS (SELECT doc_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
l AS (SELECT row_number() OVER () AS id, bad::INT AS bad, t FROM k JOIN c USING (url) JOIN b ON b.doc_id = TRY_CAST(regexp_extract(regexp_extract(k.path, '/([0-9]{1,18})([^0-9]|$)', 0), '[0-9]+') AS BIGINT)),
m AS (SELECT greatest(10, ceil(count(*) / 1000))::BIGINT AS least FROM l),
e AS (SELECT id, bad, unnest(t) AS item FROM l),
n AS (SELECT item, count(*) AS n_all, sum(bad) AS n_bad FROM e GROUP BY item HAVING sum(bad) >= (SELECT least FROM m)),
s AS (SELECT id, max(bad) AS bad, list_sort((list(item ORDER BY -(1000000 * n_bad // n_all), -n_bad, item))[1:10]) AS s FROM e JOIN n USING (item) GROUP BY id),
a AS (SELECT i, count(*) AS n_all, sum(bad) AS n_bad FROM (SELECT bad, list_filter(s, lambda x, j: (z >> (j - 1)) % 2 = 1) AS i FROM (SELECT bad, s, unnest(range(1, 1::BIGINT << len(s))) AS z FROM s)) GROUP BY i),
r AS (SELECT i FROM a WHERE n_bad >= (SELECT least FROM m) AND 100 * n_bad >= 60 * n_all),
x AS (SELECT DISTINCT url FROM c JOIN r ON list_has_all(c.t, r.i)),
g AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) v(verdict, host, path)),
w AS (SELECT h.host, h.path, arg_max({'v': g.verdict, 'r': g.host || g.path}, length(g.host || g.path)) AS w
      FROM (SELECT DISTINCT host, path FROM h) h JOIN g ON (h.host = g.host OR ends_with(h.host, '.' || g.host)) AND starts_with(h.path, g.path) GROUP BY ALL)
SELECT h.page_id, h.host, h.path, w.w.r AS rule, coalesce(w.w.v, CASE WHEN x.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN w ON w.host = h.host AND w.path = h.path LEFT JOIN x ON x.url = h.url
"""
