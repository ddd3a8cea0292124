"""Token files: ids packed at a fixed width, with block offsets for random access.

A file holds the documents of one range of doc_id in ascending order. Its ids
take the fewest bits that the vocabulary needs. Ids are cut into blocks of BLOCK
ids; each block is packed on its own and begins at a byte, so a reader finds any
id range by the table of block offsets and unpacks only those blocks, with numpy.

    "SYTOKEN1"  blocks  tables  footer
    tables: byte offset of each block (and the end) as u64, doc_id of each
            document as i64, whether it is null as u8, end of each document as
            u64 (ids from the start of the file)
    footer: bits, block ids as u32, then blocks, documents, ids, offset of the
            tables as u64, then "SYTOKEN1"

Each attempt of a task writes a file of its own name, and the manifest, which
Spark commits, names the files of the attempts that counted and where their ids
start among all files. So nothing is renamed or replaced, and what a lost task
left is never read. Files hold about FILE_BYTES of texts, however large the table.

Encoding: where a tokenizer lower-cases and never joins across white space or
letters with punctuation (see ``splits``), a worker keeps the ids of the pieces
it has seen (words, cut before punctuation, in lower case), and the new pieces
of a batch are encoded together by the tokenizers library. Pieces are looked up
by hash and compared by their bytes. Pieces that hold an added token's text in
any case are kept by their exact spelling, as added tokens are matched so. Any
other tokenizer, and texts in which two pieces share a hash, go through the
library text by text (``encode_whole``), which is also what tests compare with.

Edge cases: null and empty texts are just the end id. A null doc_id comes first.
Rows with equal doc_id are ordered by a hash of their text and then by text, and
may lie in several files. An empty table gives no files and no rows. Other
columns are ignored. A text of any length is encoded whole; only its own ids are
held in memory. Bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import json
import struct
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolake.llm.base import new_path, small_batches, stash
from symbolake.llm.textkernel import EXACT, FOLDED, buffers, chunks, hashes_at, valid, word_starts

MAGIC, FOOTER = b"SYTOKEN1", struct.Struct("<II4Q8s")
BLOCK = 1 << 14
#: Words whose ids a worker keeps.
KNOWN = 1_000_000
#: Text bytes that are encoded together.
TOGETHER = 1 << 20
#: Bytes of texts that one file takes.
FILE_BYTES = 1 << 28
#: Sets hashes of exact spellings apart from case-free ones.
SPELLED = np.uint64(0x9E3779B97F4A7C15)


def width(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(np.pad(each, ((0, 0), (0, 32 - bits))), axis=1, bitorder="little").view("<u4").ravel()


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MARK, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = True


def piece_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Case-free hashes of the pieces of texts, the first piece of each text, and where pieces start.

    A piece ends at white space and between an ASCII letter or digit and one of .,;:!?
    """
    begins = np.zeros(len(raw), bool)
    begins[word_starts(raw, offsets, FOLDED)] = True
    begins[1:] |= _MARK[raw[1:]] & _PLAIN[raw[:-1]]
    starts = np.flatnonzero(begins)
    return hashes_at(raw, starts, FOLDED), np.searchsorted(starts, offsets), starts


# How a tokenizers file says that it lower-cases and splits words from punctuation.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits(made: dict) -> bool:
    """Whether pieces of a text may be encoded one by one, whatever their case, by a tokenizer of this description."""
    steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [made.get("pre_tokenizer") or {}]
    first, rest = steps[0], steps[1:]
    cut = first.get("type") == "Split" and first.get("pattern") == {"Regex": PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
    whole = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in rest)
    plain = lambda x: not (x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"]) and x["content"].isascii() and not any(c.isspace() or c in ".,;:!?" for c in x["content"])
    model = made["model"]
    loose = made.get("truncation") or made.get("padding") or model.get("dropout")
    return made.get("normalizer") == NORMALIZER and cut and whole and model["type"] == "BPE" and not loose and all(map(plain, made["added_tokens"]))


class Encoder:
    """Ids of whole texts by a tokenizers file."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_pieces = splits(json.loads(self.tokenizer.to_str()))
        self.vocabulary = self.tokenizer.get_vocab_size()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.vocabulary, bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.added = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.spelling, self.spelled_at, self.length = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _each(self, new: list[str]) -> list[np.ndarray]:
        """Ids of each piece. Pieces of letters only are encoded many at a time: each ends at its only end-of-word id."""
        out: list[np.ndarray] = [None] * len(new)
        letters = [k for k, w in enumerate(new) if w.isalpha() and w.lower().isalpha()] if self.ends is not None else []
        groups = [letters[k : k + 500] for k in range(0, len(letters), 500)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([" ".join(new[k] for k in g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(group) and cut[-1] == len(ids):
                for k, x in zip(group, np.split(ids, cut[:-1]), strict=True):
                    out[k] = x
        rest = [k for k, x in enumerate(out) if x is None]
        for k, got in zip(rest, self.tokenizer.encode_batch_fast([new[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(got.ids, np.uint32)
        return out

    def _learn(self, hashes: np.ndarray, new: list[str], spelling: np.ndarray, length: np.ndarray) -> None:
        """Keep the ids of new pieces; ``spelling`` has their bytes as they are compared."""
        ids = self._each(new)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.pool) + np.cumsum(size) - size
        spelled_at = len(self.spelling) + np.cumsum(length) - length
        self.pool, self.spelling = np.concatenate([self.pool, *ids]), np.concatenate([self.spelling, spelling])
        order = np.argsort(np.concatenate([self.hashes, hashes]), kind="stable")
        for name, more in (("hashes", hashes), ("at", at), ("size", size), ("spelled_at", spelled_at), ("length", length)):
            setattr(self, name, np.concatenate([getattr(self, name), more])[order])

    def _plain(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = raw.tobytes()
        each = [np.array(self.encode_whole(data[a:b].decode()), np.uint32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.concatenate([np.zeros(0, np.uint32), *each]), np.concatenate([[0], np.cumsum([*map(len, each)], dtype=np.int64)])

    def _spelled(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Pieces that hold the text of an added token in any case."""
        data, found = raw.tobytes().lower(), []
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                found.append(at)
                at = data.find(token, at + 1)
        return np.unique(np.searchsorted(starts, np.array(found, np.int64), "right") - 1)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of adjacent texts, and the n + 1 offsets of each text's ids."""
        if not self.by_pieces:
            return self._plain(raw, offsets)
        hashes, first, starts = piece_hashes(raw, offsets)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        length = np.add.reduceat(FOLDED.inside[raw], starts, dtype=np.int64)
        folded = _FOLD[raw]
        spelled = self._spelled(raw, starts)
        if len(spelled):
            hashes[spelled] = hashes_at(raw, starts, EXACT)[spelled] ^ SPELLED
            at = spans(starts[spelled], length[spelled])
            folded[at] = raw[at]
        word, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        if not same(folded, starts, length, folded, starts[where][which], length[where][which]):
            return self._plain(raw, offsets)
        known = np.zeros(len(word), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, word), len(self.hashes) - 1)
            known = self.hashes[at] == word
            held, own = at[known], where[known]
            if not same(folded, starts[own], length[own], self.spelling, self.spelled_at[held], self.length[held]):
                return self._plain(raw, offsets)
        if not known.all():
            if len(self.hashes) + int((~known).sum()) > KNOWN:
                self.forget()
                known[:] = False
            data, own = raw.tobytes(), where[~known]
            new = [data[a : a + n].decode() for a, n in zip(starts[own].tolist(), length[own].tolist(), strict=True)]
            self._learn(word[~known], new, folded[spans(starts[own], length[own])], length[own])
        at = np.searchsorted(self.hashes, word)
        size = self.size[at][which]
        return self.pool[spans(self.at[at][which], size)], np.concatenate([[0], np.cumsum(size)])[first]


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of spans, one after another."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - size), size)


def same(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> bool:
    """Whether each span of ``a`` has the bytes of its span of ``b``."""
    if not (a_size == b_size).all():
        return False
    moved = np.flatnonzero((a_at != b_at) | (a is not b))
    return bool((a[spans(a_at[moved], a_size[moved])] == b[spans(b_at[moved], b_size[moved])]).all())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _open(uri: str):
    """A file system and the path in it; a path without a scheme is local."""
    if urlparse(uri).scheme:
        return pa.fs.FileSystem.from_uri(uri)
    return pa.fs.LocalFileSystem(), uri


class Writer:
    """Writes one file, block by block."""

    def __init__(self, out, bits: int, block: int):
        self.out, self.bits, self.block = out, bits, block
        self.out.write(MAGIC)
        self.place, self.offsets = len(MAGIC), [len(MAGIC)]
        self.rest, self.ids = np.zeros(0, np.uint32), 0
        self.docs, self.nulls, self.ends = [], [], []
        self.held, self.waiting = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids += len(ids)
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.ends.append(self.ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self.drain()

    def drain(self, last: bool = False) -> None:
        ids = np.concatenate([self.rest, *self.held])
        self.held = []
        whole = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, whole, self.block):
            data = pack(ids[a : min(a + self.block, whole)], self.bits)
            self.out.write(data)
            self.place += len(data)
            self.offsets.append(self.place)
        self.rest = ids[whole:]
        self.waiting = len(self.rest)

    def close(self) -> None:
        self.drain(last=True)
        for table, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.nulls, "u1"), (self.ends, "<u8")):
            self.out.write(np.array(table, kind).tobytes())
        self.out.write(FOOTER.pack(self.bits, self.block, len(self.offsets) - 1, len(self.docs), self.ids, self.place, MAGIC))


class Reader:
    """Reads one file; ``ids(a, b)`` unpacks only the blocks of that range."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        self.bits, self.block, self.blocks, self.n_docs, self.n_ids, place, magic = FOOTER.unpack(source.read_at(FOOTER.size, end - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        tables = source.read_at(end - FOOTER.size - place, place)
        self.offsets = np.frombuffer(tables, "<u8", self.blocks + 1)
        self.docs = np.frombuffer(tables, "<i8", self.n_docs, (self.blocks + 1) * 8)
        self.nulls = np.frombuffer(tables, "u1", self.n_docs, (self.blocks + 1 + self.n_docs) * 8).astype(bool)
        self.ends = np.frombuffer(tables[(self.blocks + 1) * 8 + self.n_docs * 9 :], "<u8", self.n_docs).astype(np.int64)

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.zeros(0, "<u4")
        first, last = a // self.block, (b - 1) // self.block
        data = self.source.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        parts = []
        for k in range(first, last + 1):
            at = int(self.offsets[k] - self.offsets[first])
            size = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack(data[at : at + int(self.offsets[k + 1] - self.offsets[k])], self.bits, size))
        ids = np.concatenate(parts)
        return ids[a - first * self.block : b - first * self.block]


MANIFEST = "part int, path string, n_docs long, n_ids long"


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, block: int = BLOCK) -> DataFrame:
    """Write (doc_id, text, ...) as token files in ``folder``; returns the manifest: part, path, n_docs, n_ids."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "tokens")

    def run(batches):
        code = encoder(tokenizer)
        bits = width(max(code.vocabulary, end_id + 1))
        part, writer, out = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs, root = _open(folder)
                fs.create_dir(root, recursive=True)
                name = f"part-{part:06d}-{TaskContext.get().taskAttemptId()}"
                out = fs.open_output_stream(f"{root}/{name}")
                writer = Writer(out, bits, block)
            doc_ids = batch.column(0).to_pylist()
            raw, offsets = buffers(valid(batch.column(1)))
            for lo, hi in chunks(offsets, TOGETHER):
                mine = offsets[lo : hi + 1]
                ids, at = code.encode(raw[mine[0] : mine[-1]], mine - mine[0])
                for i in range(lo, hi):
                    writer.add(doc_ids[i], np.append(ids[at[i - lo] : at[i - lo + 1]], np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.ids], pa.int64())})

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    # many rows of one doc_id are dealt to several files by the hash
    order = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    ranged = order.repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    return stash(ranged.mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest."""
    spark = manifest.sparkSession
    files, base = [], 0
    for r in manifest.orderBy("part").collect():  # one row a file
        files.append((r["path"], base))
        base += r["n_ids"]

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = _open(path)
                with fs.open_input_file(name) as source:
                    reader = Reader(source)
                    begin = np.concatenate([[0], reader.ends[:-1]]).astype(np.int64)
                    for lo in range(0, reader.n_docs, 4096):
                        hi = min(lo + 4096, reader.n_docs)
                        ids = reader.ids(int(begin[lo]), int(reader.ends[hi - 1]))
                        crc = [zlib.crc32(ids[begin[i] - begin[lo] : reader.ends[i] - begin[lo]].tobytes()) for i in range(lo, hi)]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(reader.docs[lo:hi], pa.int64(), mask=reader.nulls[lo:hi]),
                            "start": pa.array(base + begin[lo:hi]),
                            "n_tokens": pa.array(reader.ends[lo:hi] - begin[lo:hi]),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        })

    spread = spark.createDataFrame(files, "path string, base long").repartition(max(1, len(files)), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
