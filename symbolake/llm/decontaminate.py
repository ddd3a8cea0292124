"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit check.

Texts and items are sequences of words: runs of letters, digits and combining
marks of any script, whatever their case; a Han or Kana character is a word of
its own. An item of n words leaks into a text when some window of the text is
within ``floor(EDITS * n)`` word edits (insert, delete, replace) of it.

* The CGK walk reads a sequence from a start: at each step it puts out the word
  it stands on and then moves on or stays, as a coin of (repetition, step, word)
  says. Edited copies fall back into step, so edit distance becomes Hamming
  distance. A walk soon loses a copy with many edits, whatever its length; so an
  item that allows k edits is cut into k // 2 + 1 adjacent windows, one of which
  has one edit at most, and each is embedded from its beginning.
* Each of REPEATS repetitions samples SAMPLES of the first STEPS places of the
  embedding. Windows of a text that agree with a window of an item in the sample
  of some repetition are candidates. Repetitions begin at the first, second or
  third word of an item's window, so that an edit there does not spoil them all.
  REPEATS is set for a recall of 0.99 at the largest allowed distance at every
  length; the least measured, over all places of the edits, is 0.97 (items of 8
  and 9 words with their edit at the worst place).
* Of those, only places are kept where what follows in the item's window is in
  the text with one edit at most, and around which n + k words have n - k words of
  the item. Around these the edit distance of every start is computed, so what
  is returned is exact: the least distance of the leaks found, of equal ones the
  first start, and of equal ones the shortest window.

Coins are bits of a hash of the word, so nothing but the items is broadcast.
Items go to the executors in blocks of at most BLOCK_WORDS words (and one item),
about 60 MB; blocks are built, broadcast and let go one by one. Texts are read in
slices, so that a text of any length takes some 30 bytes a word.

Edge cases: null or empty texts and items have no words and never match. Items
under 1 / EDITS words allow no edit, and all of their copies are found, as a walk
without edits stays in step. Items under HALVED_BELOW words that allow edits are
found by their pieces, of which one is unedited, without loss. Chance comes near
short items; ``drop_leaks`` can be told to spare what only they match. Equal items match
the same texts, each under its own id. Rows with equal doc_id are judged one by
one; a null doc_id is kept as null. Bytes that are not UTF-8 separate words.
Other columns are ignored by ``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from symbolake.llm.base import small_batches
from symbolake.llm.textkernel import EXACT, buffers, chunks, mix, valid, word_hashes

EDITS = 0.2
#: Items with fewer words are too short to walk over: one of their halves stands unedited where they leak with one edit.
HALVED_BELOW = 8
#: Repetitions of the walk (a multiple of 8), its steps, and the steps that each repetition samples.
REPEATS, STEPS, SAMPLES = 16, 8, 4
BLOCK_WORDS = 500_000
#: Words of texts that are walked together.
SLICE = 1 << 18
#: Numbers that one numpy array of the edit check may hold.
HELD = 1 << 20

FOUND = "doc_id long, item_id long, start_word int, end_word int, distance int"


def plain(array: pa.Array) -> pa.Array:
    """Texts in lower case with one space between words."""
    text = pc.replace_substring_regex(pc.utf8_lower(valid(array)), r"[^\pL\pN\pM]+", " ")
    raw, _ = buffers(text)
    if (raw >= 0xE3).any():  # no such byte, no character that is a word of its own
        text = pc.replace_substring_regex(text, r"([\p{Han}\p{Hiragana}\p{Katakana}])", r" \1 ")
    return text


def sampled(repeat: int) -> list[int]:
    """The steps that a repetition samples: one of each equal share of the steps."""
    share = STEPS // SAMPLES
    rng = np.random.Generator(np.random.PCG64(repeat))
    return [i * share + int(rng.integers(share)) for i in range(SAMPLES)]


def join_key(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (key * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)


def coins(hashes: np.ndarray, lane: int) -> np.ndarray:
    """For each word eight bytes, one for a repetition; a byte holds the coins of the steps."""
    return mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (lane + 1) % 2**64)).view(np.uint8).reshape(-1, 8)


#: Samples after which walks whose words no item has in these places end.
EARLY = 2


def walk(words: np.ndarray, coin: np.ndarray, start: np.ndarray, steps: list[int], early: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and keys of the sampled steps of the walk from each; ``coin`` has a byte for each word.

    ``early`` flags keys of EARLY samples; walks under others end there.
    """
    at, key, taken = start.copy(), np.zeros(len(start), np.uint64), 0
    for step in range(steps[-1] + 1):
        if step in steps:
            key, taken = join_key(key, words[at]), taken + 1
            if early is not None and taken == EARLY:
                may = flagged(early, key)
                at, key, start = at[may], key[may], start[may]
        if step < steps[-1]:
            at += (coin[at] >> step) & 1
    return start, key


def flags(keys: np.ndarray) -> np.ndarray:
    """Which first bits keys have, of sixteen times as many values as there are keys."""
    bits = max(len(keys).bit_length() + 4, 10)
    out = np.zeros(1 << bits, bool)
    out[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
    return out


def flagged(flag: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Indices of the keys whose first bits are flagged."""
    return np.flatnonzero(flag[(keys >> np.uint64(65 - len(flag).bit_length())).astype(np.int64)])


class Table:
    """Keys of item windows under one sample, and where the windows stand in their items."""

    def __init__(self, repeat: int, steps: list[int], words: np.ndarray, coin: np.ndarray, begin: np.ndarray, which: np.ndarray, at: np.ndarray, left: np.ndarray, span: int, least: int):
        self.repeat, self.steps, self.span, self.least = repeat, steps, span, least
        _, keys = walk(words, coin, begin, steps)
        order = np.argsort(keys, kind="stable")
        self.keys, self.which, self.at, self.flag = keys[order], which[order], at[order], flags(keys)
        #: Where the walk begins among all items' words, and how many words its window has from there.
        self.begin, self.left = begin[order], left[order]
        self.early = flags(walk(words, coin, begin, steps[:EARLY])[1]) if len(steps) > EARLY else None


class Block:
    """Some items and the keys of their windows."""

    def __init__(self, ids: list[int], sequences: list[np.ndarray], edits: float = EDITS):
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *sequences]))
        self.vocabulary, self.ids = vocabulary, np.array(ids, np.int64)
        self.items = [np.searchsorted(vocabulary, s).astype(np.int32) + 1 for s in sequences]
        self.sizes = np.array([len(s) for s in sequences], np.int64)
        self.allowed = np.array([int(edits * len(s)) for s in sequences], np.int64)
        self.longest = int((self.sizes + self.allowed).max(initial=0))
        # which low bits of word hashes occur: most words of a text end here
        self.low = np.zeros(1 << 18, bool)
        self.low[(vocabulary & np.uint64(2**18 - 1)).astype(np.int64)] = True
        # all items behind each other, with room for a walk's end
        begin = np.cumsum(self.sizes + STEPS) - self.sizes - STEPS
        words = np.zeros(int((self.sizes + STEPS).sum()), np.int32)
        for a, item in zip(begin.tolist(), self.items, strict=True):
            words[a : a + len(item)] = item
        hashes = np.concatenate([np.zeros(1, np.uint64), vocabulary])[words]
        self.words = words
        self.tables: list[Table] = []
        exact = self.allowed == 0
        reach = np.minimum(self.sizes, STEPS)
        for n in np.unique(reach[exact & (self.sizes > 0)]).tolist():
            which = np.flatnonzero(exact & (reach == n))
            self.tables.append(Table(0, [*range(n)], words, np.ascontiguousarray(coins(hashes, 0)[:, 0]), begin[which], which, np.zeros(len(which), np.int64), np.full(len(which), n), n, n))
        # of k + 1 adjacent pieces of a short item one is unedited
        short = np.flatnonzero(~exact & (self.sizes < HALVED_BELOW))
        pieces = [(i, a, b - a) for i in short.tolist() for a, b in pairwise((np.arange(self.allowed[i] + 2) * self.sizes[i] // (self.allowed[i] + 1)).tolist()) if b > a]
        for n in sorted({size for _, _, size in pieces}):
            which, at = (np.array([x[c] for x in pieces if x[2] == n], np.int64) for c in (0, 1))
            self.tables.append(Table(0, [*range(n)], words, np.ascontiguousarray(coins(hashes, 0)[:, 0]), begin[which] + at, which, at, np.full(len(which), n), n, n))
        windows = [(i, np.arange(k // 2 + 2) * len(self.items[i]) // (k // 2 + 1)) for i, k in enumerate(self.allowed.tolist()) if k and self.sizes[i] >= HALVED_BELOW]
        if windows:
            which = np.concatenate([np.full(len(c) - 1, i) for i, c in windows])
            at, size = np.concatenate([c[:-1] for _, c in windows]), np.concatenate([np.diff(c) for _, c in windows])
            # repetitions begin at different words, so that an edit of the first one does not spoil them all
            later = np.clip(size - 3, 1, 3)
            short = int((size - later + 1).min())
            for repeat in range(REPEATS):
                if repeat % 8 == 0:
                    coin = coins(hashes, repeat // 8)
                own = at + repeat % later
                self.tables.append(Table(repeat, sampled(repeat), words, np.ascontiguousarray(coin[:, repeat % 8]), begin[which] + own, which, own, size - repeat % later, short + 1, short - 1))


def numbers(block: Block, hashes: np.ndarray) -> np.ndarray:
    """Number of each word in the block's vocabulary, 0 where it has none."""
    out = np.zeros(len(hashes), np.int32)
    may = np.flatnonzero(block.low[(hashes & np.uint64(2**18 - 1)).astype(np.int64)])
    if len(may):
        at = np.minimum(np.searchsorted(block.vocabulary, hashes[may]), len(block.vocabulary) - 1)
        out[may] = np.where(block.vocabulary[at] == hashes[may], at + 1, 0)
    return out


def leading(alike: np.ndarray) -> np.ndarray:
    """How many columns of each row are true from the left."""
    return np.logical_and.accumulate(alike, axis=1).sum(axis=1)


def one_edit(item: np.ndarray, begin: np.ndarray, left: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether ``left`` words of the items stand in the text with one edit at most (what lies behind the edit, as far as the words go)."""
    column = np.arange(int(left.max(initial=0)))
    past = column >= left[:, None]
    own = item[np.minimum(begin[:, None] + column, len(item) - 1)]
    at = start[:, None] + column
    same, later, sooner = (((own == text[np.clip(at + k, 0, len(text) - 1)]) | past) for k in (0, 1, -1))
    first, n = leading(same), len(column)
    behind = lambda alike: leading(alike[:, ::-1])
    return (same.sum(axis=1) >= n - 1) | (first + behind(later) >= n) | (first + behind(sooner) >= n - 1)


def hits(table: Table, key: np.ndarray, start: np.ndarray, block: Block, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(item index, place of the item's beginning) of every window under a key, HELD at a time."""
    may = flagged(table.flag, key)
    start, key = start[may], key[may]
    a, b = np.searchsorted(table.keys, key, "left"), np.searchsorted(table.keys, key, "right")
    may = np.flatnonzero(b > a)
    start, a, n = start[may], a[may], (b - a)[may]
    total, lo = np.cumsum(n), 0
    while lo < len(start):
        hi = max(int(np.searchsorted(total, total[lo] - n[lo] + HELD, "right")), lo + 1)
        some = n[lo:hi]
        entry = np.arange(some.sum()) + np.repeat(a[lo:hi] - (np.cumsum(some) - some), some)
        place = np.repeat(start[lo:hi], some)
        for part in range(0, len(entry), HELD // 16):
            own, where = entry[part : part + HELD // 16], place[part : part + HELD // 16]
            fine = one_edit(block.words, table.begin[own], table.left[own], words, where)
            yield table.which[own[fine]], where[fine] - table.at[own[fine]]
        lo = hi


def candidates(block: Block, words: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield distinct (item index, place) that some window's sample suggests; ``words`` ends in STEPS zeros or more."""
    known = np.concatenate([np.zeros(1, np.int32), np.cumsum(words > 0, dtype=np.int32)])
    end = len(words) - STEPS
    held, size = [], 0

    def distinct():
        found = np.unique(np.concatenate(held))
        return found // len(words), found % len(words) - block.longest

    for lo in range(0, end, SLICE):
        hi = min(lo + SLICE, end)
        here, lane, bar = words[lo : hi + STEPS], None, None
        for table in block.tables:
            if bar != (table.span, table.least):
                bar = (table.span, table.least)
                last = np.minimum(np.arange(lo, hi) + table.span, len(words))
                starts = np.flatnonzero(known[last] - known[lo:hi] >= table.least).astype(np.int32)
            if not len(starts):
                continue
            if lane != table.repeat // 8:
                lane = table.repeat // 8
                coin = coins(hashes[lo : hi + STEPS], lane)
            start, key = walk(here, np.ascontiguousarray(coin[:, table.repeat % 8]), starts, table.steps, table.early)
            for item, place in hits(table, key, start.astype(np.int64) + lo, block, words):
                k = block.allowed[item]
                # the item's words that are left are within k words of their places
                first, last = np.maximum(place - k, 0), np.clip(place + block.sizes[item] + k, 0, len(words))
                keep = known[last] - known[first] >= block.sizes[item] - k
                held.append(item[keep] * len(words) + place[keep] + block.longest)
                size += len(held[-1])
                if size > HELD:
                    yield distinct()
                    held, size = [], 0
    if size:
        yield distinct()


def start_distances(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edits between one item and what begins at each word of each row of ``text`` (and at its end)."""
    across = np.arange(text.shape[1] + 1, dtype=np.int32)
    text = text[:, ::-1]
    row = np.zeros((len(text), len(across)), np.int32)
    for i, word in enumerate(item[::-1]):
        step = row + 1
        np.minimum(step[:, 1:], row[:, :-1] + (text != word), out=step[:, 1:])
        step[:, 0] = i + 1
        row = np.minimum.accumulate(step - across, axis=1) + across
    return row[:, ::-1]


def near_starts(block: Block, item: int, places: np.ndarray, words: np.ndarray, member: np.ndarray):
    """Yield (starts, distances) of what is within the item's edits and begins at most so many words from a place."""
    own, k = block.items[item], int(block.allowed[item])
    # places near each other are looked at together; windows begin in the first ``span`` words of a row
    step = max(len(own) // 2, 4)
    span, reach = step + 2 * k, len(own) + k
    first = np.unique(places // step) * step - k
    for some in np.array_split(first, -(-len(first) * (span + reach) // HELD)):
        text = words[np.clip(some[:, None] + np.arange(span + reach), 0, len(words) - 1)]
        have = np.cumsum(np.pad(member[text], ((0, 0), (1, 0))), axis=1, dtype=np.int32)
        may = have[:, reach : reach + span] - have[:, :span] >= len(own) - k
        rows = np.flatnonzero(may.any(axis=1))
        if len(rows):
            distance = start_distances(own, text[rows])[:, :span]
            row, at = np.nonzero(distance <= k)
            yield some[rows[row]] + at, distance[row, at]


def edit_distances(item: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between one item and a beginning of each row of ``text``, and that beginning's length."""
    across = np.arange(text.shape[1] + 1, dtype=np.int32)
    row = np.broadcast_to(across, (len(text), len(across))).copy()
    for i, word in enumerate(item):
        step = row + 1
        np.minimum(step[:, 1:], row[:, :-1] + (text != word), out=step[:, 1:])
        step[:, 0] = i + 1
        row = np.minimum.accumulate(step - across, axis=1) + across
    end = row.argmin(axis=1)
    return row[np.arange(len(row)), end], end


def leaks(block: Block, array: pa.Array):
    """Rows (text, item id, start, end, distance): the best match of each text and item."""
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    if not block.longest:
        return out
    best: dict[tuple[int, int], tuple[int, int]] = {}
    member = np.zeros(len(block.vocabulary) + 1, bool)
    raw, offsets = buffers(plain(array))
    for lo, hi in chunks(offsets):
        part = offsets[lo : hi + 1]
        found, first = word_hashes(raw[part[0] : part[-1]], part - part[0], EXACT)
        # around texts lie words that no item has, so that no window crosses
        gap = max(block.longest + 1, STEPS)
        begins = first[:-1] + np.arange(1, hi - lo + 1) * gap
        ends = begins + np.diff(first)
        goal = np.arange(len(found)) + np.repeat(begins - first[:-1], np.diff(first))
        words, hashes = np.zeros(len(found) + (hi - lo + 1) * gap, np.int32), np.zeros(len(found) + (hi - lo + 1) * gap, np.uint64)
        words[goal], hashes[goal] = numbers(block, found), found
        for items, places in candidates(block, words, hashes):
            order = np.argsort(items, kind="stable")
            cuts = np.flatnonzero(np.diff(items[order])) + 1
            for part in np.split(order, cuts) if len(order) else ():
                item = int(items[part[0]])
                member[block.items[item]] = True
                for start, distance in near_starts(block, item, places[part], words, member):
                    text = np.searchsorted(begins, start, "right") - 1
                    inside = (text >= 0) & (start < ends[text])
                    for t, s, d in zip(text[inside].tolist(), start[inside].tolist(), distance[inside].tolist(), strict=True):
                        name, found = (lo + t, item), (d, s)
                        best[name] = min(best.get(name, found), found)
                member[block.items[item]] = False
        for (text, item), (distance, start) in best.items():
            own = block.items[item]
            _, size = edit_distances(own, words[None, start : start + len(own) + int(block.allowed[item])])
            place = int(start - begins[text - lo])
            found = (distance, place, place + int(size[0]))
            name = (text, int(block.ids[item]))
            out[name] = min(out.get(name, found), found)
        best.clear()
    return out


def blocks(items: DataFrame, edits: float = EDITS, min_words: int = 1) -> Iterator[Block]:
    """The benchmark (item_id, text) as blocks of bounded size, one after another."""
    ids, sequences, size = [], [], 0
    rows = items.select("item_id", "text").where("item_id is not null").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        words, _ = word_hashes(*buffers(plain(pa.array([row["text"]], pa.string()))), EXACT)
        if len(words) < min_words:
            continue
        if ids and size + len(words) > BLOCK_WORDS:
            yield Block(ids, sequences, edits)
            ids, sequences, size = [], [], 0
        ids.append(row["item_id"])
        sequences.append(words)
        size += len(words)
    if ids:
        yield Block(ids, sequences, edits)


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item that leaks into it: its best window, in words. Each block reads the texts once."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(held, batches):
        block = held.value
        for batch in batches:
            found = leaks(block, batch.column(1))
            if found:
                text = pa.array([k[0] for k in found], pa.int64())
                columns = [batch.column(0).take(text), pa.array([k[1] for k in found], pa.int64())]
                columns += [pa.array([v[i] for v in found.values()], pa.int32()) for i in (1, 2, 0)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start_word", "end_word", "distance"])

    texts = docs.select("doc_id", "text")
    parts = [texts.mapInArrow(functools.partial(run, spark.sparkContext.broadcast(b)), FOUND) for b in blocks(items)]
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FOUND)


def drop_leaks(docs: DataFrame, items: DataFrame, min_words: int = 1) -> DataFrame:
    """The documents into which no item of ``min_words`` words or more leaks, with all of their columns.

    Null and empty texts stay, so does everything where there are no items; rows
    with equal doc_id are judged one by one. All blocks are passed in one scan.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def run(held, batches):
        for batch in batches:
            found = leaks(held.value, batch.column(batch.schema.get_field_index("text")))
            keep = np.ones(batch.num_rows, bool)
            keep[[k[0] for k in found]] = False
            yield batch.filter(pa.array(keep))

    for block in blocks(items, min_words=min_words):
        docs = docs.mapInArrow(functools.partial(run, spark.sparkContext.broadcast(block)), docs.schema)
    return docs
