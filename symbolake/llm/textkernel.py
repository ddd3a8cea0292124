"""Vectorised words, hashes and shingles of whole Arrow batches of texts.

All texts of a batch lie in one UTF-8 buffer; words are found and hashed with
numpy over that buffer, so no Python code runs per word. The hash is a fixed
multilinear form over the bytes and is the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 2**63, 4093, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Text bytes that one pass over numpy arrays may hold (a longer text is one pass).
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (the splitmix constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Alphabet:
    """Which bytes belong to words, and the hash value of each."""

    def __init__(self, inside: np.ndarray, same_as: np.ndarray):
        self.inside = inside
        self.value = np.where(inside, _BYTE[same_as], np.uint64(0))


def _white() -> np.ndarray:
    white = np.zeros(256, bool)
    white[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return white


def _lower() -> np.ndarray:
    same = np.arange(256)
    same[65:91] += 32
    return same


#: Words between ASCII white space, as they are / with A-Z lower-cased.
EXACT = Alphabet(~_white(), np.arange(256))
FOLDED = Alphabet(~_white(), _lower())



def valid(array: pa.Array) -> pa.Array:
    """Texts as large strings; null counts as empty, bytes that are not UTF-8 become U+FFFD."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    try:
        array.validate(full=True)
        return array
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in array.cast(pa.large_binary()).to_pylist()], pa.large_string())


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each text; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Ranges of texts of about ``size`` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_starts(raw: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    inside = alphabet.inside[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    starts[edge] = inside[edge]
    return np.flatnonzero(starts)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and per text the index of its first word (n + 1 values)."""
    if len(raw) > 2 * CHUNK and len(offsets) == 2:
        parts = [hashes_at(raw[a:b], word_starts(raw[a:b], np.array([0, b - a]), alphabet), alphabet) for a, b in slabs(raw, alphabet)]
        hashes = np.concatenate(parts)
        return hashes, np.array([0, len(hashes)])
    starts = word_starts(raw, offsets, alphabet)
    return hashes_at(raw, starts, alphabet), np.searchsorted(starts, offsets)


def slabs(raw: np.ndarray, alphabet: Alphabet):
    """Ranges of one long text of about CHUNK bytes that end between words, so that arrays over bytes stay small."""
    a, n = 0, len(raw)
    while a < n:
        b = min(a + CHUNK, n)
        while b < n:  # on to the next byte outside words
            gap = np.flatnonzero(~alphabet.inside[raw[b : b + CHUNK]])
            b += int(gap[0]) if len(gap) else min(CHUNK, n - b)
            if len(gap):
                break
        yield a, b
        a = b


def hashes_at(raw: np.ndarray, starts: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """Hash of the word that begins at each start; bytes outside words add nothing."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    tail = raw[starts[0] :]
    sizes = np.diff(np.append(starts, len(raw)))
    place = np.arange(len(tail), dtype=np.int64) - np.repeat(starts - starts[0], sizes)
    if int(sizes.max()) > len(_PLACE):
        place %= len(_PLACE)
    value = alphabet.value[tail] * _PLACE[place]
    return mix(np.add.reduceat(value, starts - starts[0]))


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text (a shorter text: all of it), and first indices."""
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    total = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
    for j in range(k):
        total += hashes[j : j + len(total)] * _STEP[j]
    out = np.empty(at[-1], np.uint64)
    long = np.flatnonzero(n >= k)
    if len(long):
        c = counts[long]
        source = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[long], c)
        goal = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(at[long], c)
        out[goal] = total[source]
    for i in np.flatnonzero((n > 0) & (n < k)):
        own = hashes[first[i] : first[i + 1]]
        with np.errstate(over="ignore"):
            out[at[i]] = (own * _STEP[: len(own)]).sum(dtype=np.uint64) + _STEP[32 + len(own)]
    return mix(out), at


def shingle_sets(array: pa.Array, k: int = 5, alphabet: Alphabet = FOLDED):
    """Yield (row, ascending distinct shingle hashes) of every text of a batch."""
    raw, offsets = buffers(array)
    for lo, hi in chunks(offsets):
        part = offsets[lo : hi + 1]
        hashes, first = word_hashes(raw[part[0] : part[-1]], part - part[0], alphabet)
        shingles, at = shingle_hashes(hashes, first, k)
        for i in range(lo, hi):
            own = np.sort(shingles[at[i - lo] : at[i - lo + 1]])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            yield i, own
