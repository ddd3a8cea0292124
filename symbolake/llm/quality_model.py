"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a row of numbers about its whole length (FEATURES). The model
is a sum of lookup tables, one for each feature and some for pairs of features,
passed through a logistic link. Tables are learned by cyclic boosting: round
after round, each feature in turn gets a shallow tree fitted to what is still
unexplained, shrunk and added to its table. Pairs that explain most of the rest
get tables of their own in the same way. To score is to look up a bin for each
feature and to add.

Fitting runs on the driver over at most TRAIN_ROWS labelled documents, taken by
the smallest hash of their doc_id; everything else covers all rows. Features are
computed in the pass that scores; only those of the documents that are fitted
are computed before.

Edge cases: null, empty and blank texts are rows of zeros and are scored like any
other. Null labels and labels without a document are left out; a document with
several labels has their majority, ties count as 1. Without labels, or with
labels of one kind, every score is the (smoothed) share of good labels. Rows
with equal doc_id are scored one by one and fitted as one, that of the smallest
features; a null doc_id is scored and never trained on. A very long text is
measured whole, at some 40 bytes a word. Labels, lang, source and doc_id are no
inputs of a score. An empty table gives no rows. Other columns are ignored by
``classify`` and kept by ``keep_good``.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolake.llm.base import small_batches
from symbolake.llm.textkernel import CHUNK, EXACT, buffers, chunks, shingle_hashes, word_hashes

FEATURES = (
    "log_words", "word_bytes", "upper", "digit", "symbol", "mark", "bang", "pipe", "high", "line_words",
    "distinct", "top_word", "repeated", "same_lines", "short_lines", "spread",
)
TRAIN_ROWS = 20_000
KEEP_SCORE = 0.3
BINS, ROUNDS, RATE, LEAVES = 32, 160, 0.1, 3
PAIRS, PAIR_BINS, PAIR_ROUNDS = 6, 8, 60

UPPER, LOWER, DIGIT, SPACE, LINE, MARK, SYMBOL, BANG, PIPE, HIGH, LATER = range(11)


def _kinds() -> np.ndarray:
    kind = np.full(256, MARK, np.int64)
    kind[65:91], kind[97:123], kind[48:58] = UPPER, LOWER, DIGIT
    kind[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
    kind[0x0A] = LINE
    for c in b"#*$%&<>@=+^~_\\{}[]/`":
        kind[c] = SYMBOL
    kind[ord("!")], kind[ord("|")] = BANG, PIPE
    kind[128:192], kind[192:] = LATER, HIGH
    return kind


_KIND = _kinds()


def features(array: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text of a batch."""
    raw, offsets = buffers(array)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for lo, hi in chunks(offsets):
        part = offsets[lo : hi + 1] - offsets[lo]
        bytes_ = raw[offsets[lo] : offsets[hi]]
        n = hi - lo
        if n == 1:  # a text that may be very long
            count = sum((np.bincount(_KIND[bytes_[a : a + CHUNK]], minlength=11) for a in range(0, len(bytes_), CHUNK)), np.zeros(11))[None, :]
            wide = np.array([float(np.count_nonzero((bytes_[:-1] == 0xC3) & (bytes_[1:] < 0xA0)))])
        else:
            of = np.repeat(np.arange(n), np.diff(part))
            count = np.bincount(of * 11 + _KIND[bytes_], minlength=n * 11).reshape(n, 11).astype(float)
            # upper case beyond ASCII is the second byte below 0xA0 after a lead byte 0xC3
            wide = np.bincount(of[1:][(bytes_[:-1] == 0xC3) & (bytes_[1:] < 0xA0)], minlength=n) if len(bytes_) else np.zeros(n)
        hashes, first = word_hashes(bytes_, part, EXACT)
        shingles, at = shingle_hashes(hashes, first, 3)
        words = np.diff(first).astype(float)
        some = np.maximum(words, 1)
        size = np.maximum(np.diff(part) - count[:, LATER], 1)
        letters = np.maximum(count[:, UPPER] + count[:, LOWER] + count[:, HIGH], 1)
        x = out[lo:hi]
        x[:, 0] = np.log2(1 + words)
        x[:, 1] = (np.diff(part) - count[:, SPACE] - count[:, LINE]) / some
        x[:, 2] = (count[:, UPPER] + wide) / letters
        x[:, 3] = count[:, DIGIT] / size
        x[:, 4] = count[:, SYMBOL] / some
        x[:, 5] = count[:, MARK] / some
        x[:, 6] = count[:, BANG] / some
        x[:, 7] = count[:, PIPE] / some
        x[:, 8] = count[:, HIGH] / letters
        x[:, 9] = np.log2(1 + words / (1 + count[:, LINE]))
        for i in range(n):
            own = hashes[first[i] : first[i + 1]]
            if not len(own):
                continue
            _, times = np.unique(own, return_counts=True)
            x[i, 10] = len(times) / len(own)
            x[i, 11] = times.max() / len(own)
            runs = np.sort(shingles[at[i] : at[i + 1]])
            x[i, 12] = (runs[1:] == runs[:-1]).sum() / len(runs)
            x[i, 15] = np.log2(1 + len(times) ** 2 / len(own))
        for i in np.flatnonzero(count[:, LINE] > 0):
            lines = bytes_[part[i] : part[i + 1]].tobytes().split(b"\n")
            x[i, 13] = 1 - len(set(lines)) / len(lines)
            x[i, 14] = sum(len(line) < 24 for line in lines) / len(lines)
    return out


@dataclass
class Model:
    """Cut points of the bins, tables of features and of pairs, and an intercept."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]) if self.cuts else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        c = self.coarse(b)
        for i, j, t in self.pairs:
            total += t[c[:, i], c[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def coarse(self, b: np.ndarray) -> np.ndarray:
        """Bins as cells of the pair tables: each feature's own bins in PAIR_BINS equal shares, or as they are where they are few."""
        have = np.array([len(c) + 1 for c in self.cuts], np.int64)
        return np.where(have > PAIR_BINS, b * PAIR_BINS // have, b) if len(have) else b


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """Value of each bin by a tree with few leaves over sums of gradients and curvatures."""
    spans, value = [(0, len(grad))], np.zeros(len(grad))
    gain_of = lambda g, h: g * g / (h + 1.0)
    while len(spans) < leaves:
        best = None
        for k, (a, b) in enumerate(spans):
            if b - a < 2:
                continue
            g, h = np.cumsum(grad[a:b])[:-1], np.cumsum(hess[a:b])[:-1]
            all_g, all_h = grad[a:b].sum(), hess[a:b].sum()
            gain = gain_of(g, h) + gain_of(all_g - g, all_h - h) - gain_of(all_g, all_h)
            at = int(gain.argmax())
            if gain[at] > 1e-9 and (best is None or gain[at] > best[0]):
                best = (gain[at], k, a + at + 1)
        if best is None:
            break
        _, k, at = best
        a, b = spans[k]
        spans[k : k + 1] = [(a, at), (at, b)]
    for a, b in spans:
        value[a:b] = grad[a:b].sum() / (hess[a:b].sum() + 1.0)
    return value


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best split of a grid into four quadrants: its gain and the value of each cell."""
    g, h = (np.pad(z.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for z in (grad, hess))
    n = len(grad)
    best, value = 0.0, np.zeros_like(grad)
    for i in range(1, n):
        for j in range(1, n):
            parts = []
            for z in (g, h):
                q = z[i, j]
                parts.append((q, z[i, n] - q, z[n, j] - q, z[n, n] - z[i, n] - z[n, j] + q))
            gain = sum(a * a / (b + 1.0) for a, b in zip(*parts, strict=True))
            if gain > best:
                best = gain
                v = [a / (b + 1.0) for a, b in zip(*parts, strict=True)]
                value = np.zeros_like(grad)
                value[:i, :j], value[:i, j:], value[i:, :j], value[i:, j:] = v
    return best, value


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit to rows of features and labels 0 or 1, the same for the same rows in any order of equal rows."""
    good = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(good / (1 - good))))
    if len(y) == 0 or y.min() == y.max():
        return model
    for j in range(x.shape[1]):
        model.cuts.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="higher")))
    b = model.bins(x)
    model.tables = [np.zeros(BINS) for _ in model.cuts]
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    def boost_all(rounds: int):
        for _ in range(rounds):
            for j, table in enumerate(model.tables):
                grad, hess = slopes()
                step = RATE * _tree(np.bincount(b[:, j], grad, BINS), np.bincount(b[:, j], hess, BINS), LEAVES)
                table += step
                total[:] += step[b[:, j]]

    boost_all(ROUNDS)
    grad, hess = slopes()
    c = model.coarse(b)
    found = []
    grid = lambda i, j, z: np.bincount(c[:, i] * PAIR_BINS + c[:, j], z, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            found.append((_quadrants(grid(i, j, grad), grid(i, j, hess))[0], i, j))
    best = sorted(found, key=lambda f: (-f[0], f[1], f[2]))[:PAIRS]
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in best]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            grad, hess = slopes()
            step = RATE * _quadrants(grid(i, j, grad), grid(i, j, hess))[1]
            table += step
            total[:] += step[c[:, i], c[:, j]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def measured(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id of every row and its features, or its score by a model."""
    small_batches(docs.sparkSession)

    def run(model, batches):
        for batch in batches:
            x = features(batch.column(1))
            columns = [pa.array(x[:, j]) for j in range(len(FEATURES))] if model is None else [pa.array(model.score(x))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(FEATURES if model is None else ["score"])])

    names = FEATURES if model is None else ["score"]
    return docs.select("doc_id", "text").mapInArrow(functools.partial(run, model), "doc_id long, " + ", ".join(f"{f} double" for f in names))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit to the labelled documents that are not held out.

    Null and repeated labels are treated as the module says; without labelled
    documents the model is a constant.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label_"))
    picked = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    found = measured(docs.join(picked.select("doc_id"), "doc_id", "left_semi"))
    # one row a doc_id, however many the table has of it
    one = found.groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("x")).select("doc_id", "x.*")
    got = one.join(picked, "doc_id").toArrow()  # bounded by rows
    x = np.column_stack([got[f].to_numpy() for f in FEATURES]).reshape(-1, len(FEATURES))
    y = got["label_"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y, got["doc_id"].to_numpy()))
    return fit(x[order], y[order])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = measured(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all of their columns.

    Rows with equal doc_id are judged one by one; null and empty texts are judged
    as rows of zeros; a null doc_id is kept as null. An empty table stays empty.
    """
    model = train(docs, labels)

    def run(model, batches):
        for batch in batches:
            score = model.score(features(batch.column(batch.schema.get_field_index("text"))))
            yield batch.filter(pa.array(score >= KEEP_SCORE))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(functools.partial(run, model), docs.schema)
