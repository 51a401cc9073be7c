"""Media columns: PNG images in binary columns, written and read with zlib and numpy, and low-frequency cosine hashes of them.

A payload of bytes becomes the 8-bit samples of an RGB image that is 64 pixels (192 bytes) wide; the decoder checks the
signature, every chunk's checksum, the size of the inflated data and undoes all five scan-line filters.

Defined results: a null text is the empty text; an empty text pads to one row of 192 spaces; a text of any length is
stored whole. Equal texts give equal bytes and features, as everything is computed by integers row by row. Repeated rows
give repeated results, an empty table an empty one. Only the id and text columns are read, so other columns can't clash.
Images that aren't 8-bit gray, RGB or RGBA without interlacing raise ValueError, as do damaged ones.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

ROW = 192  # bytes of a payload in an image row
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 6: 4}  # by colour type
IDAT_BYTES = 1 << 20
LEVEL = 4
SIDE, LOW = 32, 8  # the hash takes the LOW x LOW lowest frequencies of a SIDE x SIDE image


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def payload_of(text: bytes) -> bytes:
    """The text and spaces up to a positive multiple of ROW."""
    return text + b" " * (max(1, -(-len(text) // ROW)) * ROW - len(text))


def encode_png(payload: bytes, level: int = LEVEL) -> bytes:
    """The payload as an RGB image; a scan line takes filter 1 or 2 where that makes it much smaller in absolute values, else 0."""
    raw = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(raw), ROW + 1), np.uint8)
    lines[:, 1:] = raw
    if len(raw) > 1:
        left, up = raw.copy(), raw.copy()
        left[:, 3:] -= raw[:, :-3]
        up[1:] -= raw[:-1]
        cost = np.stack([np.abs(x.view(np.int8)).view(np.uint8).sum(1, dtype=np.int64) for x in (raw, left, up)])
        cost[1:] *= 4  # text deflates best as it is
        best = cost.argmin(0)
        for k, x in ((1, left), (2, up)):
            lines[best == k, 0] = k
            lines[best == k, 1:] = x[best == k]
    data = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", ROW // 3, len(raw), 8, 2, 0, 0, 0)
    parts = [chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES)]
    return b"".join([SIGNATURE, chunk(b"IHDR", head), *parts, chunk(b"IEND", b"")])


def decode_png(media: bytes) -> np.ndarray:
    """Samples as (height, width, channels)."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, data, ended = 8, None, [], False
    while at + 12 <= len(media) and not ended:
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if len(body) < n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended, at = kind == b"IEND", at + 12 + n
    if head is None or not ended:
        raise ValueError("no header or no end")
    width, height, depth, colour, packed, filtered, interlaced = head
    if depth != 8 or colour not in CHANNELS or packed or filtered or interlaced:
        raise ValueError("only 8-bit gray, RGB or RGBA images without interlacing")
    c = CHANNELS[colour]
    flat = zlib.decompress(b"".join(data))
    if len(flat) != height * (width * c + 1):
        raise ValueError("the image data have another size than the header says")
    return unfilter(np.frombuffer(flat, np.uint8).reshape(height, width * c + 1), c).reshape(height, width, c)


def unfilter(lines: np.ndarray, c: int) -> np.ndarray:
    """Scan lines without their filters. Runs of lines of one filter are undone at once where the filter allows it."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise ValueError("unknown filter")
    ends = np.flatnonzero(np.diff(kinds, append=255 - int(kinds[-1]))) + 1 if len(kinds) else []
    start = 0
    for end in map(int, ends):
        k, above = kinds[start], out[start - 1] if start else np.zeros(out.shape[1], np.uint8)
        rows = out[start:end]
        if k == 1:
            rows[:] = np.add.accumulate(rows.reshape(end - start, -1, c), axis=1, dtype=np.uint8).reshape(rows.shape)
        elif k == 2:
            rows[0] += above
            np.add.accumulate(rows, axis=0, dtype=np.uint8, out=rows)
        elif k > 2:
            for row in rows:
                _undo(row.reshape(-1, c), above.reshape(-1, c).astype(np.int16), k == 4)
                above = row
        start = end
    return out


def _undo(row: np.ndarray, above: np.ndarray, paeth: bool) -> None:
    left = corner = np.zeros(row.shape[1], np.int16)
    for i in range(len(row)):
        up = above[i]
        if paeth:
            p, q, r = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
            guess = np.where((p <= q) & (p <= r), left, np.where(q <= r, up, corner))
        else:
            guess = (left + up) // 2
        row[i] = (row[i] + guess) & 255
        left, corner = row[i].astype(np.int16), up


#: Cosine table in whole numbers, so that equal images give equal hashes on any machine.
COSINES = np.rint(4096 * np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE))).astype(np.int64)


def shrink(gray: np.ndarray) -> np.ndarray:
    """SIDE x SIDE whole means of blocks; an image with fewer rows or columns repeats them."""
    for axis in (0, 1):
        n = gray.shape[axis]
        if n >= SIDE:
            at = np.arange(SIDE) * n // SIDE
            count = np.diff(at, append=n)
            gray = np.add.reduceat(gray, at, axis=axis) // (count[:, None] if axis == 0 else count)
        else:
            gray = gray.take(np.arange(SIDE) * n // SIDE, axis=axis)
    return gray


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hex digits: which of the 63 lowest frequencies without the mean, and the mean at first, exceed their median."""
    gray = shrink(pixels.sum(2, dtype=np.int64))
    low = (COSINES @ gray @ COSINES.T).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def encode(df: DataFrame, text: str = "text", doc_id: str = "doc_id", level: int = LEVEL) -> DataFrame:
    """doc_id, n_bytes and the image of each text in the binary column media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches):
            texts = [t or b"" for t in common.as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array((encode_png(payload_of(t), level) for t in texts), pa.binary())], schema=MEDIA)

    return df.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def features(media: DataFrame) -> DataFrame:
    """What the stored images hold, read back from the column media; a null image gives nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for b in common.chunks(batches, "media"):
            rows = [of(*r) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def of(doc_id: int, n: int, stored: bytes | None) -> tuple:
        if stored is None:
            return (doc_id, n, *[None] * 8)
        pixels = decode_png(stored)
        back = pixels.tobytes()
        return (doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(pixels), pixels.shape[1], pixels.shape[0])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def restore(media: DataFrame) -> DataFrame:
    """doc_id and text: the exact texts out of the images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "media"):
            texts = [None if m is None else decode_png(m).tobytes()[:n].decode() for n, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, text string")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(encode(common.table(spark, sf_dir, "documents")))


QUERIES = {"op3_media_columns": op3_media_columns}
SQL: dict[str, str] = {}
