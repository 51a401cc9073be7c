"""Token ids in packed matrices: best-fit decreasing with a segment tree over capacities.

Documents become ids of a byte-level BPE vocabulary, with an end mark each. A document longer than a row is split without
loss into full rows and a rest. Rests are packed longest first into the row with the least room that is enough; a
segment tree over the rooms finds it. Rows are written as id matrices with the cumulative lengths of their segments and positions
that start anew at each segment.

Packing works on groups of GROUP_TOKENS tokens within a partition, in the order in which they are read, so it needs no shuffle, a task holds a bounded
number of tokens and a lost task packs the same rows again.

Defined results: a null text is the empty text, and an empty text is its end mark alone; special marks within a text are ordinary
text; rows that repeat are packed again; an empty table gives an empty result. Only id and text are read. The vocabulary file is
read on the driver, from its own disk or any place that Spark can read, and goes to the tasks with the job (MAX_RANKS bytes at
most); how rows are grouped follows how the input is divided, so another division packs other rows of the same segments.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary splits a text before the merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
ROW_TOKENS = 2048
GROUP_TOKENS = 1 << 20
MAX_CACHE = 200_000
LONG, BLOCK = 1 << 20, 1 << 16  # characters from which on pieces are held in blocks, and pieces of a block
MAX_RANKS = 64 << 20


def ranks(spark: SparkSession, path: str = RANKS) -> bytes:
    """A vocabulary file, whole."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            raw = f.read(MAX_RANKS + 1)
    else:
        files = spark.read.format("binaryFile").load(path)
        raw = files.select("content").first()[0] if files.filter(F.col("length") <= MAX_RANKS).count() else None
    if raw is None or len(raw) > MAX_RANKS:
        raise ValueError(f"{path} isn't there or has more than {MAX_RANKS} bytes")
    return bytes(raw)


@lru_cache(maxsize=2)
def encoding(raw: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Pieces(dict):
    """Piece of a text to the bytes of its ids (little-endian int32)."""

    def __init__(self, raw: bytes):
        super().__init__()
        self.encode = encoding(raw).encode_ordinary
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = np.array(self.encode(piece), "<i4").tobytes()
        return ids

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text; the pieces of a long one are held BLOCK at a time."""
        if len(text) <= LONG:
            return np.frombuffer(b"".join(map(self.__getitem__, self.pattern.findall(text))), "<i4")
        found, parts = (m[0] for m in self.pattern.finditer(text)), []
        while block := list(islice(found, BLOCK)):
            parts.append(b"".join(map(self.__getitem__, block)))
        return np.frombuffer(b"".join(parts), "<i4")


class Rooms:
    """Segment tree over rooms 0 to n: how many rows have each; finds the least room that is enough."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.tree = np.zeros(2 * self.size, np.int64).tolist()
        self.rows: list[list[int]] = [[] for _ in range(n + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, row) of the row with the least room >= length, taken out."""
        i = length + self.size
        if not self.tree[i]:
            while i > 1 and not (i % 2 == 0 and self.tree[i + 1]):  # up to where something lies to the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of numbers of pieces, each of at most width in all; longest first, ties in order."""
    rooms, rows = Rooms(width), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[i])
        if found is None:
            rows.append([i])
            rooms.put(width - lengths[i], len(rows) - 1)
        else:
            room, row = found
            rows[row].append(i)
            rooms.put(room - lengths[i], row)
    return rows


PACKED = "n_tokens int, n_segments int, doc_ids array<long>, doc_offsets array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"
NAMES = [c.split()[0] for c in PACKED.split(", ")]
KINDS = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]


def pack_group(docs: list[tuple[int | None, np.ndarray]], width: int) -> list[tuple]:
    """Packed rows of the ids of some documents; padded with END, which counts in no segment."""
    pieces = [(doc, at, ids[at : at + width]) for doc, ids in docs for at in range(0, len(ids), width)]
    out = []
    for row in best_fit([len(p[2]) for p in pieces], width):
        ids, position = np.full(width, END, "<i4"), np.zeros(width, "<i4")
        ends = [0]
        for i in row:
            n = len(pieces[i][2])
            ids[ends[-1] : ends[-1] + n] = pieces[i][2]
            position[ends[-1] : ends[-1] + n] = np.arange(n)
            ends.append(ends[-1] + n)
        out.append((ends[-1], len(row), [pieces[i][0] for i in row], [pieces[i][1] for i in row], ends, ids.tobytes(), position.tobytes()))
    return out


def pack(docs: DataFrame, width: int = ROW_TOKENS, path: str = RANKS, group: int = GROUP_TOKENS) -> DataFrame:
    """Rows of width ids. doc_offsets: the first token of each segment within its document; cu_seqlens: 0 and the segments' ends."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks(docs.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, waiting, size = Pieces(shared.value), [], 0

        def packed() -> pa.RecordBatch:
            rows = pack_group(waiting, width)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)

        for b in common.chunks(batches):
            if len(pieces) > MAX_CACHE:
                pieces.clear()
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(pieces.ids(text or ""), np.int32(END)).astype("<i4")
                waiting.append((doc, ids))
                size += len(ids)
                if size >= group:
                    yield packed()
                    waiting, size = [], 0
        if waiting:
            yield packed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def unpack(packed: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, doc_offset, bytes): the text bytes of each segment, without the end mark."""
    shared = packed.sparkSession.sparkContext.broadcast(ranks(packed.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoding(shared.value).decode_bytes
        for b in common.chunks(batches, "input_ids"):
            rows = []
            for docs, at, ends, ids in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                ids = np.frombuffer(ids, "<i4")
                for d, o, s, e in zip(docs, at, ends, ends[1:], strict=False):
                    own = ids[s:e]
                    rows.append((d, o, decode(own[own != END].tolist())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "doc_offset", "bytes"])

    return packed.select("doc_ids", "doc_offsets", "cu_seqlens", "input_ids").mapInArrow(run, "doc_id long, doc_offset int, bytes binary")



def op5_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(common.table(spark, sf_dir, "documents"))
    return packed.select("n_tokens", "n_segments", "doc_ids", "doc_offsets", "cu_seqlens", F.crc32("input_ids").alias("ids_crc32"), "input_ids", "position_ids")


QUERIES = {"op5_bfd_packing": op5_bfd_packing}
SQL: dict[str, str] = {}
