"""Chat formatting in budgeted, turn-aligned windows with a loss mask.

A conversation's turns are framed as ``<|im_start|>role\\ntext<|im_end|>\\n``. In
texts every run of bars after a ``<`` gets one more bar, so that a mark (one bar)
can never come from a text, and taking one bar off gives the text back. Roles
also have backslash and newline escaped.

Windows: turns are laid out by the running sum of their tokens (words, and
FRAME for the frame). A window takes whole turns until the next would exceed
BUDGET; a longer turn has a window of its own, uncut. Each later window begins
with the system turn (if the first turn is one) and with as many whole turns of
history as fit in HISTORY tokens. The loss mask covers texts of assistant turns
that are new in their window, so every target counts once; repeated turns are
context. No conversation is gathered in one place: token counts are gathered by
BLOCK turns, and of a longer conversation one row carries the start of the window
that is open from block to block (some 1.6 KB a block); sums over a conversation of more than HOT turns are taken in parts by
turn number, and go on from the sums of the parts before; texts meet their windows
by the hash of their row, so that they are read twice and written only as windows.

A window is one row: conv_id, window, text, n_context (turns that are repeats)
and loss, an array of (start, chars) spans of code points in text. Windows of a
conversation are numbered in its order, from a multiple of BLOCK on in each block.
``read_back`` recovers turns and targets from these columns alone; as it returns a
conversation's turns in one row, it does gather those.

Edge cases: null text and null role are empty. Equal turn numbers are ordered by
role and text, equal rows are turns of their own. A null conv_id is one
conversation, a null turn comes first. Conversations without assistant turns have
an empty mask. A very long text is a window of its own, in one row. An empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolake.llm.base import fits, let, lookup, n_words, stash

BUDGET, HISTORY, FRAME = 400, 100, 4
#: Turns that are cut into windows together, and turns of a conversation that are summed up in one task.
BLOCK, HOT = 4096, 1_000_000
#: Most parts of a conversation's turns that are summed by themselves.
PARTS = 1024
START, END = "<|im_start|>", "<|im_end|>"
TARGET = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\|+)", r"<|$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\|+)", r"<$1")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    plain = F.replace(role, F.lit("\\\\"), F.lit("\\\x00"))
    return unescape(F.replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), F.lit("\\\x00"), F.lit("\\")))


KEY = ["key", "key2"]


def keyed(conversations: DataFrame) -> DataFrame:
    """Turns without nulls in role and text, and 128 bits of hashes that name a row's content."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    return rows.select("*", F.xxhash64("conv_id", "turn", "role", "text").alias("key"), F.xxhash64("text", "role", "turn", "conv_id", F.lit(2)).alias("key2"))


def numbered(turns: DataFrame) -> DataFrame:
    """For each turn its key, its place in the conversation and the tokens before it.

    Texts move for the order only where turn and role are equal.
    """
    light = turns.select("conv_id", "turn", "role", (n_words(F.col("text")) + FRAME).alias("tokens"), *KEY, F.xxhash64("conv_id", "turn", "role").alias("same"))
    light = stash(light, "turns")
    ties = stash(light.groupBy("same", *KEY).agg(F.lit(1).alias("one")).groupBy("same").count().where("count > 1").select("same"), "ties")
    ordered = light.withColumn("tie", F.lit(None).cast("string"))
    if ties.limit(1).count():
        tied = lookup(turns.select(*KEY, "text", F.xxhash64("conv_id", "turn", "role").alias("same")), ties, ["same"], "left_semi")
        tied = tied.groupBy(*KEY).agg(F.min("text").alias("tie"))
        ordered = light.join(tied, KEY, "left")
    parted, before = _in_parts(ordered)
    order = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "tie")
    up = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at, sums = F.row_number().over(order).cast("long") - 1, F.sum("tokens").over(up) - F.col("tokens")
    placed = parted.select(*KEY, "conv_id", "part", at.alias("i"), (F.col("role") == "system").alias("system"), "tokens", sums.alias("before"))
    if before is not None:
        same = F.col("conv_id").eqNullSafe(F.col("hot_")) & (F.col("part") == F.col("of_"))
        placed = placed.join(F.broadcast(before) if fits(before) else before, same, "left")
        placed = placed.withColumns({"i": F.col("i") + F.coalesce("i_", F.lit(0)), "before": F.col("before") + F.coalesce("before_", F.lit(0))})
    return stash(placed.select(*KEY, "conv_id", "i", "system", "tokens", "before"), "places")


def _in_parts(turns: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Turns with a part, 0 but for conversations of more than HOT turns; and the turns and tokens before each of their parts."""
    some = turns.groupBy(F.col("conv_id").alias("hot_")).agg(F.count(F.lit(1)).alias("n"))
    some = stash(some.where(F.col("n") > HOT), "hot")
    if not some.limit(1).count():
        return turns.withColumn("part", F.lit(0)), None
    side = F.broadcast(some) if fits(some) else some
    # bounds that cut a conversation's turns into parts of about HOT rows, whatever the numbers are
    hot = turns.join(side, F.col("conv_id").eqNullSafe(F.col("hot_")))
    count = F.max(F.ceil(F.col("n") / HOT).cast("int"))
    quantiles = F.percentile_approx("turn", [k / PARTS for k in range(1, PARTS)], 20 * PARTS)
    bounds = hot.groupBy("hot_").agg(quantiles.alias("q"), count.alias("parts"))
    step = F.greatest(F.floor(PARTS / F.col("parts")).cast("int"), F.lit(1))
    bounds = stash(bounds.select("hot_", F.lit(1).alias("is_hot"), F.array_distinct(F.filter("q", lambda x, i: (i + 1) % step == 0)).alias("cuts")), "cuts")
    near = F.broadcast(bounds) if fits(bounds) else bounds
    part = F.when(F.col("is_hot").isNull(), 0).when(F.col("turn").isNull(), -1).otherwise(F.size(F.filter("cuts", lambda x: x < F.col("turn"))))
    parted = stash(turns.join(near, F.col("conv_id").eqNullSafe(F.col("hot_")), "left").withColumn("part", part).drop("hot_", "is_hot", "cuts"), "parts")
    sums = parted.join(side, F.col("conv_id").eqNullSafe(F.col("hot_")), "left_semi").groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("k"), F.sum("tokens").alias("t"))
    up = Window.partitionBy("conv_id").orderBy("part")
    before = sums.select(F.col("conv_id").alias("hot_"), F.col("part").alias("of_"), (F.sum("k").over(up) - F.col("k")).alias("i_"), (F.sum("t").over(up) - F.col("t")).alias("before_"))
    return parted, stash(before, "sums")


def one_of_each(turns: DataFrame, places: DataFrame) -> DataFrame:
    """key, role and text of every content; equal rows, which their places count, once."""
    some = stash(places.groupBy(*KEY).count().where("count > 1").select(*KEY), "repeats")
    rows = turns.select(*KEY, "role", "text")
    if not some.limit(1).count():
        return rows
    repeated = lookup(rows, some, KEY, "left_semi").groupBy(*KEY).agg(F.min("role").alias("role"), F.min("text").alias("text"))
    return lookup(rows, some, KEY, "left_anti").unionByName(repeated)


def _entries(counts: DataFrame, budget: int) -> DataFrame:
    """conv_, block_, entry, next of every block of long conversations: the first window start in the block, as a place in it, and the first in the blocks after it (or the end).

    A window has at most budget // FRAME turns (or is one longer turn), so the first
    start of a block is among its first turns, or in a later block. Each block says
    where the last window begins that follows from each such start; one pass over
    these few numbers of a conversation's blocks then carries the open window's
    start from block to block.
    """
    reach = budget // FRAME + 2
    size = lambda t: t["before"] + t["tokens"]  # noqa: E731  tokens up to a turn's end
    # the turn that begins the next window after one that begins at x
    after = lambda x, i: i + 1 + F.size(F.filter(F.slice("t", i + 2, reach), lambda y: size(y) - x["before"] <= budget))
    back = F.sequence(F.size("t") - 1, F.lit(0), F.lit(-1))
    last = F.aggregate(back, F.array().cast("array<int>"), lambda a, i: F.concat(F.array(F.when(F.get("next_", i) >= F.size("t"), i).otherwise(F.get(a, F.get("next_", i) - i - 1))), a))
    some = counts.withColumn("next_", F.transform("t", after)).withColumn("last_", F.slice(last, 1, reach))
    few = some.select("conv_id", "block", F.transform(F.slice("t", 1, reach), size).alias("sizes"), F.transform("last_", lambda k: F.get("t", k)["before"]).alias("starts"), (F.element_at("t", -1)["i"] + 1).alias("end"))
    whole = few.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "sizes", "starts"))).alias("b"), F.max("end").alias("n"))
    zero = F.struct(F.lit(None).cast("long").alias("open"), F.array().cast("array<struct<block:bigint,entry:int>>").alias("found"))

    def step(a, b):
        # sizes ascend, so the first that is too much follows those that are not; block 0 begins with its first turn
        fit = F.when(a["open"].isNull(), 0).otherwise(F.size(F.filter(b["sizes"], lambda x: x - a["open"] <= budget)))
        return let(fit, lambda k: F.struct(F.coalesce(F.get(b["starts"], k), a["open"]).alias("open"), F.concat(a["found"], F.array(F.struct(b["block"].alias("block"), F.when(k < F.size(b["sizes"]), k).alias("entry")))).alias("found")))

    found = whole.select("conv_id", "n", F.explode(F.aggregate("b", zero, step, lambda a: a["found"])).alias("f")).select("conv_id", "n", "f.*")
    later = Window.partitionBy("conv_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    first = F.first(F.when(F.col("entry").isNotNull(), F.col("block") * BLOCK + F.col("entry")), ignorenulls=True).over(later)
    return found.select(F.col("conv_id").alias("conv_"), F.col("block").alias("block_"), "entry", F.coalesce(first, "n").alias("next"))


def spans(places: DataFrame, budget: int) -> DataFrame:
    """conv_id, window, first, end, start (tokens before it) of every window; the token counts of BLOCK turns are gathered."""
    block = F.floor(F.col("i") / BLOCK).alias("block")
    counts = places.groupBy("conv_id", block).agg(F.sort_array(F.collect_list(F.struct("i", "before", "tokens"))).alias("t"))
    long = stash(places.where(F.col("i") == BLOCK).select(F.col("conv_id").alias("long_")), "long")
    if long.limit(1).count():
        side = F.broadcast(long) if fits(long) else long
        entries = stash(_entries(counts.join(side, F.col("conv_id").eqNullSafe(F.col("long_")), "left_semi"), budget), "entries")
        same = F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("block") == F.col("block_"))
        counts = counts.join(F.broadcast(entries) if fits(entries) else entries, same, "left")
        counts = counts.withColumn("entry", F.when(F.col("block_").isNull(), 0).otherwise(F.col("entry"))).where("entry is not null")
    else:
        counts = counts.withColumns({"entry": F.lit(0), "next": F.lit(None).cast("long")})
    n = F.coalesce("next", F.element_at("t", -1)["i"] + 1)
    counts = counts.select("conv_id", "block", n.alias("n"), F.slice("t", F.col("entry") + 1, F.size("t")).alias("t"))
    head = F.get("t", F.lit(0))
    zero = F.array(F.struct(head["i"].alias("first"), head["before"].alias("start")))
    # a window ends before the first turn that would take it over the budget
    over = lambda a, t: (t["i"] > head["i"]) & (t["before"] + t["tokens"] - F.element_at(a, -1)["start"] > budget)
    cut = lambda a, t: F.when(over(a, t), F.concat(a, F.array(F.struct(t["i"].alias("first"), t["before"].alias("start"))))).otherwise(a)
    starts = counts.select("conv_id", "block", "n", F.aggregate("t", zero, cut).alias("s"))
    every = F.transform("s", lambda s, k: F.struct((F.col("block") * BLOCK + k).alias("window"), s["first"].alias("first"), F.coalesce(F.get("s", k + 1)["first"], F.col("n")).alias("end"), s["start"].alias("start")))
    return starts.select("conv_id", F.explode(every).alias("s")).select("conv_id", "s.*")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, n_context, loss: the formatted windows of every conversation."""
    turns = keyed(conversations)
    places = numbered(turns)
    span = spans(places, budget).withColumnRenamed("conv_id", "conv")
    # a turn has FRAME tokens or more, so history reaches back a bounded number of turns
    near = F.sequence(F.greatest(F.col("first") - history // FRAME, F.lit(0)), F.col("end") - 1)
    wanted = span.select("*", F.explode(F.array_union(F.array(F.lit(0)), near)).alias("at"))
    member = places.join(wanted, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("i") == F.col("at")))
    context = (F.col("start") - F.col("before") <= history) | ((F.col("i") == 0) & F.col("system"))
    member = stash(member.where((F.col("i") >= F.col("first")) | context).select(*KEY, "conv_id", "window", "i", (F.col("i") < F.col("first")).alias("old")), "members")
    rows = lookup(one_of_each(turns, places), member, KEY, "inner")
    head, body = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    framed = F.concat(head, body, F.lit(END), F.lit("\n"))
    turn = F.struct("i", "role", framed.alias("text"), F.length(framed).alias("chars"), F.length(head).alias("head"), F.length(body).alias("body"))
    grouped = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("all"), F.sum(F.col("old").cast("int")).cast("int").alias("n_context"))

    def mask(all_):
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast("array<struct<start:int,chars:int>>").alias("loss"))
        new = lambda a, t: (a["k"] >= F.col("n_context")) & (t["role"] == TARGET)
        here = lambda a, t: F.array(F.struct((a["at"] + t["head"]).alias("start"), t["body"].alias("chars")))
        step = lambda a, t: F.struct((a["at"] + t["chars"]).alias("at"), (a["k"] + 1).alias("k"), F.when(new(a, t), F.concat(a["loss"], here(a, t))).otherwise(a["loss"]).alias("loss"))
        return F.aggregate(all_, start, step, lambda a: a["loss"])

    return grouped.select("conv_id", "window", F.array_join(F.transform("all", lambda t: t["text"]), "").alias("text"), "n_context", mask(F.col("all")).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns (role and text, in order), target (all text under the mask), formatted_chars."""
    # windows are gathered as they are, so that each text moves once
    rows = formatted.select("conv_id", F.struct("window", "text", "n_context", "loss").alias("w"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    # text of a turn may end in "<": its marks are those with exactly one bar, found from the left
    frames = lambda x: F.regexp_extract_all(x["text"], F.lit(r"(?s)<\|im_start\|>(.*?)<\|im_end\|>\n"), 1)
    new = lambda x: let(frames(x), lambda f: F.slice(f, x["n_context"] + 1, F.size(f)))
    turn = lambda t: F.struct(unescape_role(F.substring_index(t, "\n", 1)).alias("role"), unescape(F.substring(t, F.locate("\n", t) + 1, F.length(t))).alias("text"))
    target = lambda x: F.array_join(F.transform(x["loss"], lambda s: unescape(F.substring(x["text"], s["start"] + 1, s["chars"]))), "")
    turns = F.flatten(F.transform("w", lambda x: F.transform(new(x), turn)))
    chars = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]))
    return whole.select("conv_id", turns.alias("turns"), F.array_join(F.transform("w", target), "").alias("target"), chars.alias("formatted_chars"))


def digest(conversations: DataFrame) -> DataFrame:
    """What ``read_back`` finds in the written windows, as counts and SHA-256 digests."""
    back = read_back(stash(windows(conversations), "chat", "zstd"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("target").cast("long").alias("loss_chars"), F.sha2(F.col("target").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


ORACLE = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS n,
             length('<|im_start|>' || regexp_replace(role, '<(\|+)', '<|\1', 'g') || chr(10) || regexp_replace(text, '<(\|+)', '<|\1', 'g') || '<|im_end|>' || chr(10)) AS chars FROM c),
g(conv_id, i, first, used) AS (SELECT conv_id, 1::BIGINT, 1::BIGINT, n FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.i, CASE WHEN g.used + t.n > 400 THEN t.i ELSE g.first END, CASE WHEN g.used + t.n > 400 THEN t.n ELSE g.used + t.n END
  FROM g JOIN t ON t.conv_id IS NOT DISTINCT FROM g.conv_id AND t.i = g.i + 1),
w AS (SELECT DISTINCT conv_id, first FROM g WHERE first > 1),
h AS (SELECT w.conv_id, sum(CASE WHEN t.i = 1 AND t.role = 'system' THEN t.chars
         WHEN (SELECT sum(n) FROM t b WHERE b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i >= t.i AND b.i < w.first) <= 100 THEN t.chars ELSE 0 END) AS extra
      FROM w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i < w.first GROUP BY w.conv_id)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(chars) + coalesce(any_value(extra), 0))::BIGINT AS formatted_chars
FROM t LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY t.conv_id
"""
