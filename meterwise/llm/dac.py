"""Token ids in directly addressable codes.

An id is split into bytes, low first. Level 0 holds the first byte of every id, level 1 the second byte of those that
have one, and so on; a continuation bitmap per level says which ids go on, and a rank directory (set bits before each
512-bit block) tells where they stand on the next level. So any id is found from a position in a few steps, without
decoding what stands before it.

A file is a Parquet part that Spark writes and reads, each row a block: the codes of a run of whole documents, with
their ids and first positions. Blocks stand in ascending order of doc_id (null first; then text). Nulls and empty
texts have the end id alone.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.common import WHITE, documents, partitions, ranges, text_chunks

END = 1
MAGIC = b"DAC1"
BLOCK = 512


class Codes:
    """Codes of an array of ids below 2**32."""

    def __init__(self, count: int, levels: list[np.ndarray], bits: list[np.ndarray], ranks: list[np.ndarray]):
        self.count, self.levels, self.bits, self.ranks = count, levels, bits, ranks

    @classmethod
    def encode(cls, ids: np.ndarray) -> Codes:
        rest = np.asarray(ids, np.uint32)
        levels, bits, ranks = [], [], []
        while True:
            levels.append((rest & np.uint32(255)).astype(np.uint8))
            rest = rest >> np.uint32(8)
            more = rest > 0
            packed = np.packbits(more, bitorder="little")
            bits.append(packed)
            counts = np.bitwise_count(np.pad(packed, (0, -packed.size % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint32) if counts.size else counts)
            rest = rest[more]
            if not rest.size:
                return cls(len(ids), levels, bits, ranks)

    def to_bytes(self) -> bytes:
        head = struct.pack("<4sIQ", MAGIC, len(self.levels), self.count) + b"".join(struct.pack("<Q", x.size) for x in self.levels)
        return head + b"".join(x.tobytes() for three in zip(self.levels, self.bits, self.ranks, strict=True) for x in three)

    @classmethod
    def from_bytes(cls, data: bytes) -> Codes:
        magic, n, count = struct.unpack_from("<4sIQ", data)
        if magic != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        sizes, at = struct.unpack_from(f"<{n}Q", data, 16), 16 + 8 * n
        levels, bits, ranks = [], [], []
        for size in sizes:
            for out, kind, length in ((levels, np.uint8, size), (bits, np.uint8, -(-size // 8)), (ranks, "<u4", -(-size // BLOCK))):
                out.append(np.frombuffer(data, kind, length, at))
                at += out[-1].nbytes
        return cls(count, levels, bits, ranks)

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> int:
        """The id at a position: one byte, bit and rank for each level, nothing else is read."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        out = 0
        for level, (codes, bits, ranks) in enumerate(zip(self.levels, self.bits, self.ranks, strict=True)):
            out |= int(codes[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            own = bits[block * (BLOCK // 8) : (i >> 3) + 1].copy()
            own[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(np.bitwise_count(own).sum())
        return out

    def decode(self) -> np.ndarray:
        out = np.zeros(self.count, np.uint32)
        at = np.arange(self.count)
        for level, (codes, bits) in enumerate(zip(self.levels, self.bits, strict=True)):
            out[at] |= codes.astype(np.uint32) << np.uint32(8 * level)
            at = at[np.unpackbits(bits, count=codes.size, bitorder="little").astype(bool)]
        return out


#: Bytes between letters at which the tokenizer's own pattern always parts words: white space, and these signs where an
#: ASCII or Latin letter stands on the other side.
SIGNS = np.isin(np.arange(256), np.frombuffer(b"!#$%&*.,;:?(){}[]=+/_-@~^", np.uint8))
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_tokenizers: dict = {}


class Words:
    """A tokenizer and the ids of the words it met lately, as bytes; old words go when there are too many."""

    def __init__(self, path: str, most: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> list[bytes]:
        young = self.young
        out = list(map(young.get, words))
        unseen = [i for i, x in enumerate(out) if x is None]
        older = list(map(self.old.get, map(words.__getitem__, unseen)))
        missing = []
        for i, x in zip(unseen, older, strict=True):
            if x is None:
                missing.append(i)
            else:
                out[i] = young[words[i]] = x
        for lo in range(0, len(missing), 2000):
            at = missing[lo : lo + 2000]
            run = list(map(words.__getitem__, at))
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]
            ends = np.cumsum(list(map(len, ids))) * 4
            raw = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
            begin = 0
            for i, w, end in zip(at, run, ends.tolist(), strict=True):
                out[i] = young[w] = raw[begin:end]
                begin = end
        if len(young) > self.most:
            self.old, self.young = young, {}
        return out


def words_of(path: str) -> Words:
    if path not in _tokenizers:
        _tokenizers[path] = Words(path)
    return _tokenizers[path]


def _pieces(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes without white space, cuts into pieces whose ids don't depend on each other, and the first piece of each text."""
    white = WHITE[data]
    cut = np.zeros(data.size + 1, bool)
    cut[offsets] = True
    cut[1:] |= white
    cut[:-1] |= white
    letter, sign = LETTERS[data], SIGNS[data]
    # two-byte letters U+00C0..U+017F but for the signs of multiplication and division, and for the dotted capital I,
    # whose small form ends with a mark that the tokenizer joins to a sign
    lead, tail = data[:-1], data[1:]
    latin = ((lead == 0xC3) & (tail >= 0x80) & (tail != 0x97) & (tail != 0xB7)) | ((lead >= 0xC4) & (lead <= 0xC5) & ~((lead == 0xC4) & (tail == 0xB0)))
    first, last = letter.copy(), letter.copy()
    first[:-1] |= latin
    last[1:] |= latin
    cut[1:-1] |= (last[:-1] & sign[1:]) | (sign[:-1] & first[1:])
    keep = ~white
    before = np.concatenate([[0], np.cumsum(keep)])
    edges = before[np.flatnonzero(cut)]  # in order; cuts around white space meet
    edges = edges[np.diff(edges, prepend=-1) > 0]
    body = data[keep]
    if not (data == 60).any():  # without <, no special token of the vocabulary can be met by lowering
        body = LOWER[body]
    return body, edges, np.searchsorted(edges, before[offsets])


def encode_texts(offsets: np.ndarray, data: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of texts one after the other, and how many each has; each distinct word is encoded once."""
    body, edges, first = _pieces(offsets, data)
    flat = pa.Array.from_buffers(pa.large_string(), edges.size - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(body)]) if edges.size > 1 else pa.array([], pa.large_string())
    coded = flat.dictionary_encode()
    own = words_of(path).ids(coded.dictionary.to_pylist())
    size = np.fromiter(map(len, own), np.int64, len(own)) // 4
    ids = np.frombuffer(b"".join(own), "<u4")
    code = coded.indices.to_numpy(zero_copy_only=False)
    counts = size[code]
    sums = np.concatenate([[0], np.cumsum(counts)])
    return ids[ranges((np.cumsum(size) - size)[code], counts)], sums[first[1:]] - sums[first[:-1]]


FILE = "part int, seq int, n_docs long, n_tokens long, doc_ids binary, no_id binary, first binary, codes binary"


def encode(docs: DataFrame, path: str, end: int = END, block_bytes: int = 4 << 20) -> DataFrame:
    """Blocks of codes, in ascending order of doc_id over (part, seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            for lo, hi, offsets, data in text_chunks(batch, most=block_bytes):
                rows = batch.slice(lo, hi - lo)
                ids, counts = encode_texts(offsets, data, path)
                at = np.cumsum(counts)
                ids = np.insert(ids, at, end)
                first = np.concatenate([[0], at + np.arange(1, at.size + 1)])
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [rows.num_rows], "n_tokens": [ids.size],
                    "doc_ids": [rows.column("doc_id").fill_null(0).to_numpy().astype("<i8").tobytes()], "no_id": [np.packbits(rows.column("doc_id").is_null().to_numpy(zero_copy_only=False)).tobytes()],
                    "first": [first.astype("<u4").tobytes()], "codes": [Codes.encode(ids).to_bytes()],
                })
                seq += 1

    rows = documents(docs)
    rows = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return rows.mapInArrow(run, FILE)


def write(docs: DataFrame, folder: str, path: str, end: int = END) -> None:
    """The blocks as Parquet, not compressed, so that a code is read where it stands without decoding a page."""
    encode(docs, path, end).write.mode("errorifexists").option("compression", "uncompressed").parquet(folder)


def read(blocks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of each document, decoded from the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                first = np.frombuffer(row["first"], "<u4").astype(np.int64)
                ids = Codes.from_bytes(row["codes"]).decode().astype("<u4").tobytes()
                none = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=row["n_docs"]).astype(bool)
                n = row["n_docs"]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * n, pa.int32()), "seq": pa.array([row["seq"]] * n, pa.int32()), "doc_id": pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=none),
                    "first": first[:-1], "n_tokens": np.diff(first), "ids_crc32": pa.array([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(first[:-1], first[1:], strict=True)], pa.int64()),
                })

    rows = blocks.mapInArrow(run, "part int, seq int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return rows.join(_starts(blocks).drop("n_tokens"), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def _starts(blocks: DataFrame) -> DataFrame:
    """part, seq, n_tokens and base (ids in all blocks before) of each block."""
    sizes = blocks.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each part of the file: as many as the job has partitions, whatever the rows
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = sizes.select("part", "seq", "n_tokens", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("here"))
    return inside.join(parts, "part").select("part", "seq", "n_tokens", (F.col("before") + F.col("here")).alias("base"))


def token(blocks: DataFrame, position: int) -> int | None:
    """The id at a position of the whole file, from its block alone."""
    hit = _starts(blocks).where((F.col("base") <= position) & (position < F.col("base") + F.col("n_tokens"))).first()
    if hit is None:
        return None
    row = blocks.where((F.col("part") == hit["part"]) & (F.col("seq") == hit["seq"])).select("codes").first()
    return Codes.from_bytes(bytes(row[0]))[position - hit["base"]]
